"""URL filtering against sorted digest arrays.

A list of strings (hosts, or host plus path prefix) becomes one file: sorted
64-bit XXH64 digests, each entry's verdict and offset, and the strings
themselves.  Executors fetch the file once through Spark's file distribution,
memory-map it, probe it with a vectorised binary search and confirm every digest
hit on the stored string, so that a collision never decides.

A list beyond ``MAX_BYTES`` is not shipped: probes and list then meet in a
shuffled join on (digest, string).

Defined results: a null url, or one without ``://``, has empty host and path, no
rule and the default verdict; repeated urls get repeated results; an empty list
decides nothing; other columns of the input pass unread.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoframe.llm.common import shared_dir

#: The largest digest file that is sent to executors.
MAX_BYTES = 1 << 30
_HEAD = struct.Struct("<8sQQ")
_MAGIC = b"mfdigest"
_LOWER = {c: c + 32 for c in range(65, 91)}


def build(entries: Iterable[tuple[str, str]]) -> bytes:
    """The digest file of (string, verdict) entries; of equal strings the first counts."""
    first: dict[bytes, bytes] = {}
    for text, verdict in entries:
        first.setdefault(text.encode(), verdict.encode())
    order = sorted((xxhash.xxh64_intdigest(k), k) for k in first)
    digests = np.array([h for h, _ in order], dtype="<u8")
    blob, ends = bytearray(), [0]
    for _, k in order:
        blob += k + b"\0" + first[k]
        ends.append(len(blob))
    lengths = np.array(sorted({len(k.partition(b"/")[1] + k.partition(b"/")[2]) for k in first}), dtype="<u8")
    return _HEAD.pack(_MAGIC, len(order), len(lengths)) + digests.tobytes() + np.array(ends, dtype="<u8").tobytes() + lengths.tobytes() + bytes(blob)


class DigestArray:
    """A memory-mapped digest file."""

    def __init__(self, data: np.ndarray):
        magic, n, k = _HEAD.unpack(data[: _HEAD.size].tobytes())
        if magic != _MAGIC:
            raise ValueError("not a digest file")
        at = _HEAD.size
        self.digests = data[at : (at := at + 8 * n)].view("<u8")
        self.ends = data[at : (at := at + 8 * (n + 1))].view("<u8")
        #: Lengths in bytes of the entries' parts from the first slash on.
        self.path_lengths = data[at : (at := at + 8 * k)].view("<u8").tolist()
        self.blob = data[at:]

    @classmethod
    def open(cls, path: str) -> DigestArray:
        return cls(np.memmap(path, dtype=np.uint8, mode="r"))

    @classmethod
    def of(cls, entries: Iterable[tuple[str, str]]) -> DigestArray:
        return cls(np.frombuffer(build(entries), dtype=np.uint8))

    def find(self, probes: list[bytes]) -> list[str | None]:
        """The verdict of each probe that the array holds."""
        out: list[str | None] = [None] * len(probes)
        if not len(self.digests) or not probes:
            return out
        keys = np.fromiter(map(xxhash.xxh64_intdigest, probes), dtype="<u8", count=len(probes))
        at = np.searchsorted(self.digests, keys)
        hit = np.flatnonzero(self.digests[np.minimum(at, len(self.digests) - 1)] == keys)
        for i in hit:
            j = int(at[i])
            while j < len(self.digests) and self.digests[j] == keys[i]:  # equal digests stand together
                text, _, verdict = self.blob[int(self.ends[j]) : int(self.ends[j + 1])].tobytes().rpartition(b"\0")
                if text == probes[i]:
                    out[i] = verdict.decode()
                    break
                j += 1
        return out


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url."""
    if not url or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((x for x in (rest.find("?"), rest.find("#")) if x >= 0), default=len(rest))
    slash = rest.find("/", 0, end)
    if slash < 0:
        return rest[:end].translate(_LOWER), ""
    return rest[:slash].translate(_LOWER), rest[slash:end]


def probes_of(host: str, path: str, path_lengths: list[int]) -> list[bytes]:
    """Every string that a rule fitting this url can be, longest first: domain suffixes with the path's prefixes of the listed lengths."""
    if not host:
        return []
    labels, h, p = [], host.encode(), path.encode()
    while True:
        labels.append(h)
        if (dot := h.find(b".")) < 0:
            break
        h = h[dot + 1 :]
    found = {d + p[:n] for d in labels if d for n in path_lengths if n <= len(p)}
    return sorted(found, key=lambda x: (-len(x), x))


def decide(urls: list, rules: DigestArray, hosts: DigestArray, default: str) -> tuple[list, list, list, list]:
    """Hosts, paths, rules and verdicts; the longest fitting rule decides, then the longest fitting list entry, then ``default``."""
    split = [split_url(u) for u in urls]
    found: list[list[tuple[str, str] | None]] = []
    for array in (rules, hosts):
        flat: list[bytes] = []
        ends = [0]
        for h, p in split:
            flat += probes_of(h, p, array.path_lengths)
            ends.append(len(flat))
        verdicts = array.find(flat)
        found.append([next(((flat[i].decode(), v) for i in range(a, b) if (v := verdicts[i])), None) for a, b in zip(ends, ends[1:])])
    rule = [x and x[0] for x in found[0]]
    verdict = [x[1] if x else y[1] if y else default for x, y in zip(*found)]
    return [h for h, _ in split], [p for _, p in split], rule, verdict


def _ship(spark: SparkSession, data: bytes) -> str:
    """Put ``data`` into the shared folder and have Spark fetch it to every executor; returns the file's name there."""
    name = f"digests-{uuid.uuid4().hex}.bin"
    jvm, path = spark.sparkContext._jvm, f"{shared_dir(spark)}/mnemoframe/{name}"
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    spark.sparkContext.addFile(path)
    return name


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], hosts: list[tuple[str, str]] = (), url: str = "url", key: str = "page_id", default: str = "allow") -> DataFrame:
    """For each row: key, host, path, rule and verdict.

    ``rules`` and ``hosts`` are (string, verdict) lists in the form ``host/path-prefix`` or ``host``;
    a fitting rule overrides the host list, which overrides ``default``.
    """
    spark = pages.sparkSession
    parts = [build(rules), build(hosts)]
    if sum(map(len, parts)) > MAX_BYTES:
        return _joined(pages, rules, hosts, url, key, default)
    names = [_ship(spark, x) for x in parts]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        arrays = [DigestArray.open(SparkFiles.get(x)) for x in names]
        for b in batches:
            h, p, r, v = decide(b["u"].tolist(), *arrays, default)
            yield pd.DataFrame({"k": b["k"], "host": h, "path": p, "rule": pd.Series(r, dtype=object, index=b.index), "verdict": v})

    kind = pages.schema[key].dataType.simpleString()
    rows = pages.select(F.col(key).alias("k"), F.col(url).cast("string").alias("u"))
    return rows.mapInPandas(run, f"k {kind}, host string, path string, rule string, verdict string").withColumnRenamed("k", key)


def _joined(pages: DataFrame, rules: list, hosts: list, url: str, key: str, default: str) -> DataFrame:
    """The same for lists too large to ship: a shuffled join of probes with the list."""
    spark = pages.sparkSession
    entries = spark.createDataFrame([(0, *x) for x in rules] + [(1, *x) for x in hosts], "level int, entry string, v string")
    lengths = [sorted({len((x.partition("/")[1] + x.partition("/")[2]).encode()) for x, _ in part}) for part in (rules, hosts)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row, k, u in zip(b["row"], b["k"], b["u"]):
                h, p = split_url(u)
                out.append((row, k, h, p, [(i, x.decode()) for i in (0, 1) for x in probes_of(h, p, lengths[i])]))
            yield pd.DataFrame(out, columns=["row", "k", "host", "path", "probes"])

    kind = pages.schema[key].dataType.simpleString()
    rows = pages.select(F.col(key).alias("k"), F.col(url).cast("string").alias("u")).groupBy("k", "u").count()
    rows = rows.select(F.xxhash64("k", "u").alias("row"), "k", "u", "count")
    split = rows.select("row", "k", "u").mapInPandas(run, f"row long, k {kind}, host string, path string, probes array<struct<level:int,entry:string>>")
    probes = split.select("row", F.inline("probes"))
    order = F.struct(-F.col("level"), F.length("entry"), F.col("entry"))
    won = probes.join(entries, ["level", "entry"]).groupBy("row").agg(F.max_by(F.struct("level", "entry", "v"), order).alias("w"))
    out = split.drop("probes").join(won, "row", "left").join(rows.select("row", "count"), "row")
    return out.select(
        F.col("k").alias(key), "host", "path", F.when(F.col("w.level") == 0, F.col("w.entry")).alias("rule"), F.coalesce("w.v", F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("_n")
    ).drop("_n")
