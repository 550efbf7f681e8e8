"""The native memory store: a table of (user_id, seq, raw_id, text, lang_detected, metadata), in write order.

Every operator takes the table and returns the new one; nothing is changed in place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemoframe.functions import text as X
from mnemoframe.plans import lineage
from mnemoframe.schemas import STORE


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STORE)


def reset(store: DataFrame, user_id: str) -> DataFrame:
    return store.filter(F.col("user_id") != user_id)


def write(store: DataFrame, turns: DataFrame, user_id: str | Column) -> DataFrame:
    """Append a record for each turn, in order of seq, to the store of a user, or of the user that a column of the turns names."""
    turns = turns.withColumn("_user", F.lit(user_id) if isinstance(user_id, str) else user_id.cast("string"))
    last = store.groupBy(F.col("user_id").alias("_user")).agg(F.max("seq").alias("_last"))
    seq = F.coalesce("_last", F.lit(-1)) + F.row_number().over(Window.partitionBy("_user").orderBy("seq"))
    rows = turns.join(last, "_user", "left").withColumn("n", seq)
    meta = F.create_map(F.lit("session_id"), F.col("session_id").cast("string"), F.lit("kind"), F.col("kind"), F.lit("fact_id"), F.col("fact_id"))
    name = F.concat(F.lit("mem_"), F.col("n").cast("string"))
    return store.unionByName(rows.select(F.col("_user").alias("user_id"), F.col("n").cast("long").alias("seq"), name.alias("raw_id"), "text", F.col("lang").alias("lang_detected"), meta.alias("metadata")))


#: A correction is appended; the record it corrects stays.
update = write


def consolidate(store: DataFrame, by: tuple[str, ...] = ("user_id", "text"), order: str = "seq") -> DataFrame:
    """Exact duplicates removed, the first of each kept."""
    w = Window.partitionBy(*by).orderBy(order)
    return store.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def latest(store: DataFrame, by: tuple[str, ...] = ("user_id", "text"), order: str = "seq") -> DataFrame:
    """The last record of each key."""
    w = Window.partitionBy(*by).orderBy(F.col(order).desc())
    return store.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def dump(store: DataFrame, user_id: str) -> DataFrame:
    """A user's records as a snapshot has them, (seq, raw_id, text, lang_detected, metadata), in write order by ``seq``."""
    return store.filter(F.col("user_id") == user_id).drop("user_id")


#: Records of a store up to which retrieval joins on every token; beyond, by bounds.
PLAIN_RECORDS = 100_000
#: Rarest tokens of a query, and records of each, that give the first bound on its k-th best score.
SEEDS, SEED_RECORDS = 3, 64
#: Records, and queries, of one lot at most; characters from which on a text counts as several of them.
RECORD_LOT, QUERY_LOT, LONG = 32_768, 65_536, 4_000
#: Pairs, and shared tokens, of a block, that are counted together.
CELLS = SHARED = 1 << 20
#: Share of a lot's pairs from which on a token is counted by a matrix product; entries of a lot's matrices at most.
DENSE, MATRIX = 0.003, 1 << 26


def _words(c: Column) -> Column:
    return F.array_distinct(X.words(F.lower(c)))


def retrieve(store: DataFrame, queries: DataFrame, k: int = 5, plan: str = "auto") -> DataFrame:
    """(query_id, rank, score, and the record): the k records of the query's user with most tokens in common, ties in write order.

    ``queries``: (query_id, user_id, query).  Records that share a token are found by one of two plans with equal results:

    * ``join``: on every token;
    * ``bounded``: queries and records meet in lots, where they are counted in blocks: tokens that many pairs share by a matrix
      product, the others from lists of their holders.  Only pairs above the k-th best score of the query so far are looked at
      further; what is shuffled are texts and the k best of each lot, never pairs.

    The rest, all with score 0, fill up in write order from the first k records of the user.
    """
    if plan == "auto":
        plan = "join" if store.limit(PLAIN_RECORDS + 1).count() <= PLAIN_RECORDS else "bounded"
    scored = {"join": _by_every_token, "bounded": _by_bounds}[plan](store, queries, k)
    w = Window.partitionBy("user_id").orderBy("seq")
    head = store.select("user_id", "seq").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")
    filler = queries.select("query_id", "user_id").join(head, "user_id").select("query_id", "user_id", "seq", F.lit(0).cast("long").alias("score"))
    # among the first k records some may have a score: they appear twice and the better row counts
    both = scored.unionByName(filler).groupBy("query_id", "user_id", "seq").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "seq"))
    top = both.withColumn("rank", rank).filter(F.col("rank") <= k)
    return top.join(store, ["user_id", "seq"])


def _by_every_token(store: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    q = queries.select("query_id", "user_id", F.explode(_words(F.col("query"))).alias("word"))
    m = store.select("user_id", "seq", F.explode(_words(F.col("text"))).alias("word"))
    return q.join(m, ["user_id", "word"]).groupBy("query_id", "user_id", "seq").agg(F.count(F.lit(1)).alias("score"))


def _by_bounds(store: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    asked = queries.select("query_id", "user_id", _joined("query")).filter("words <> ''")
    best = _best_of_lots(store, lineage.cut(asked), k)
    rank = F.row_number().over(Window.partitionBy("query_id", "user_id").orderBy(F.col("score").desc(), "seq"))
    return best.withColumn("_n", rank).filter(F.col("_n") <= k).drop("_n")


def _joined(text: str) -> Column:
    """``words``: the tokens of a text, null: none, with a space between them, which needs less room than a list."""
    return F.coalesce(F.array_join(_words(F.col(text)), " "), F.lit("")).alias("words")


def _best_of_lots(store: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, user_id, seq, score): of each lot of records the k best of each query, by all tokens.

    A user's records are dealt to parts if they are many, and so are their queries; users with few share a lot.
    """
    long = lambda c: F.sum(F.greatest(F.lit(1), F.ceil(F.length(c) / LONG))).cast("long")
    users = lineage.cut(store.groupBy("user_id").agg(long("text").alias("records")).join(asked.groupBy("user_id").agg(long("words").alias("asked")), "user_id"))
    records, queries = users.agg(F.coalesce(F.sum("records"), F.lit(0)), F.coalesce(F.sum("asked"), F.lit(0))).first()
    lots = 4 * store.sparkSession.sparkContext.defaultParallelism  # smaller lots where these would be fewer than all cores take
    of = {"records": min(RECORD_LOT, max(RECORD_LOT // 8, records // lots)), "asked": QUERY_LOT}
    many = lambda n: F.ceil(F.col(n) / F.lit(of[n])).cast("int")
    homes = max(1, -(-records // of["records"]), -(-queries // of["asked"]))
    home = F.pmod(F.xxhash64("user_id"), F.lit(homes)).cast("int")
    users = users.select("user_id", home.alias("home"), many("records").alias("parts"), many("asked").alias("query_parts"))
    both = F.col("parts") * F.col("query_parts")
    tasks = 2 * (homes + users.agg(F.coalesce(F.sum(F.when(both > 1, both)), F.lit(0))).first()[0])  # a number, as lots are small but work much
    users = lineage.small(users)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = asked.join(users, "user_id").select(F.col("home").alias("home"), each("parts").alias("part"), dealt("query_id", "query_parts").alias("query_part"), *asked.columns)
    right = store.select("user_id", "seq", _joined("text")).filter("words <> ''").join(users, "user_id")
    right = right.select(F.col("home").alias("home"), dealt("seq", "parts").alias("part"), each("query_parts").alias("query_part"), "user_id", "seq", "words")
    kinds = [T.StructField(c, df.schema[c].dataType) for c, df in (("query_id", asked), ("user_id", asked), ("seq", store))]
    lot = ("home", "part", "query_part")

    def best(q: pa.Table, r: pa.Table) -> pa.Table:
        split = lambda t: pc.split_pattern(t.column("words"), " ")
        q = q.append_column("needed", split(q)).append_column("floor", pa.array(np.ones(q.num_rows, np.int64)))
        return _best(q, r.set_column(r.column_names.index("words"), "words", split(r)), k)

    left, right = (x.repartition(tasks, *lot).groupBy(*lot) for x in (left, right))
    return left.cogroup(right).applyInArrow(best, T.StructType([*kinds, T.StructField("score", T.LongType())]))


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """(row of each entry, entries) of a column of lists."""
    sizes = pc.list_value_length(column).to_numpy().astype(np.int64)
    return np.repeat(np.arange(len(sizes)), sizes), pc.list_flatten(column)


def _codes(values: pa.ChunkedArray, among: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.index_in(values, value_set=among), -1).to_numpy().astype(np.int64)


def _expand(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs of ``sizes`` at ``starts``, one after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _best(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """The k best records of ``right`` for each query of ``left``, of those with ``floor`` of the ``needed`` tokens and one at least; a token counts as that of its user."""
    users = pc.unique(left.column("user_id"))
    left = left.take(pa.array(np.argsort(_codes(left.column("user_id"), users), kind="stable")))
    owner = _codes(right.column("user_id"), users)
    right = right.take(pa.array(np.lexsort((right.column("seq").to_numpy(), owner))))  # ties by place
    asking, owner = _codes(left.column("user_id"), users), np.sort(owner)
    n, m = left.num_rows, right.num_rows
    # tokens of queries and of records as numbers of those that both have, each query's and record's in one run
    (row, needed), (record, held) = _lists(left.column("needed")), _lists(right.column("words"))
    words = pc.unique(needed)
    held, needed = _codes(held, words), asking[row] * len(words) + _codes(needed, words)
    known = (held >= 0) & (owner[record] >= 0)
    record, held = record[known], owner[record[known]] * len(words) + held[known]
    keys = pa.array(np.intersect1d(needed, held))
    needed, held = _codes(pa.array(needed), keys), _codes(pa.array(held), keys)
    row, needed, record, held = row[needed >= 0], needed[needed >= 0], record[held >= 0], held[held >= 0]
    # the commonest are columns of matrices
    shared = np.bincount(needed, minlength=len(keys)) * np.bincount(held, minlength=len(keys))
    dense = np.argsort(-shared, kind="stable")[: MATRIX // max(1, n + m)]
    dense = dense[shared[dense] > DENSE * n * m]
    column = np.full(len(keys), -1)
    column[dense] = np.arange(len(dense))

    def halves(place: np.ndarray, token: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A matrix of the common tokens, and (place, token) of the others."""
        c = column[token]
        has = np.zeros((size, len(dense)), np.uint8)
        has[place[c >= 0], c[c >= 0]] = 1
        return has, place[c < 0], token[c < 0]

    wants, row, needed = halves(row, needed, n)
    has, record, held = halves(record, held, m)
    floor = np.maximum(left.column("floor").to_numpy(), 1) - 1
    side = max(1, int(CELLS**0.5))
    found = [np.zeros((3, 0), np.int64)]
    for a in range(0, n, side):
        b = min(n, a + side)
        found.append(_block(wants[a:b], has, *_lists_of(row, needed, a, b, len(keys)), record, held, np.searchsorted(owner, (asking[a], asking[b - 1] + 1)), floor[a:b], k))
        found[-1][0] += a
    q, r, score = np.concatenate(found, axis=1)
    q = pa.array(q)
    return pa.table({"query_id": left.column("query_id").take(q), "user_id": left.column("user_id").take(q), "seq": right.column("seq").take(pa.array(r)), "score": pa.array(score, pa.int64())})


def _lists_of(row: np.ndarray, token: np.ndarray, a: int, b: int, tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows from ``a`` to ``b`` that have a token, token by token: where its rows begin, how many there are, the rows."""
    own = slice(*np.searchsorted(row, (a, b)))
    sizes = np.bincount(token[own], minlength=tokens)
    return np.cumsum(sizes) - sizes, sizes, row[own][np.argsort(token[own], kind="stable")] - a


def _block(wants: np.ndarray, has: np.ndarray, starts: np.ndarray, sizes: np.ndarray, rows: np.ndarray, record: np.ndarray, held: np.ndarray, span: np.ndarray, floor: np.ndarray, k: int) -> np.ndarray:
    """(query, record, score) of the k best records of each query, in the order of the records, over those of ``span``.

    A later record needs a better score than the k-th best before it, so that ``floor``, the score to exceed, rises.
    """
    n = len(wants)
    wants = wants.astype(np.float32)
    own = slice(*np.searchsorted(record, span))
    own = np.arange(own.start, own.stop)[sizes[held[own]] > 0]
    record, held = record[own], held[own]
    costs = np.concatenate(([0], np.cumsum(sizes[held])))
    best, new, waiting = np.zeros((3, 0), np.int64), [], 0

    def kept() -> np.ndarray:
        q, r, score = np.concatenate((best, *new), axis=1)
        order = np.lexsort((r, -score, q))
        q, r, score = q[order], r[order], score[order]
        nth = np.arange(len(q)) - np.searchsorted(q, np.arange(n))[q]
        floor[q[nth == k - 1]] = score[nth == k - 1]
        return np.stack((q, r, score))[:, nth < k]

    floor = floor.copy()
    b, end = span
    while b < end:
        a = b
        first = np.searchsorted(record, a)  # as many records as CELLS and SHARED allow, one at least
        most = np.searchsorted(costs, costs[first] + SHARED, side="right") - 1
        b = min(end, a + max(1, CELLS // n), max(a + 1, record[most] if most < len(record) else end))
        last = np.searchsorted(record, b)
        score = wants @ has[a:b].T.astype(np.float32)
        size = sizes[held[first:last]]
        np.add.at(score.reshape(-1), rows[_expand(starts[held[first:last]], size)] * (b - a) + np.repeat(record[first:last] - a, size), np.float32(1))
        good = np.flatnonzero(score > floor[:, None].astype(np.float32))
        if len(good) > 8 * k * n:  # at first all pass: the k-th best of the block bounds them
            least = np.partition(score, b - a - k, axis=1)[:, b - a - k] if b - a > k else np.zeros(n)
            good = np.flatnonzero(score > np.maximum(floor, least - 1)[:, None].astype(np.float32))
        q, r = np.divmod(good, b - a)
        new.append(np.stack((q, r + a, score.reshape(-1)[good].astype(np.int64))))
        waiting += len(good)
        if waiting >= k * n:
            best, new, waiting = kept(), [], 0
    return kept()


def _in_full(store: DataFrame, queries: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, user_id, seq, score) of the pairs ``found``, by all tokens of both texts."""
    both = found.join(queries.select("query_id", _words(F.col("query")).alias("qw")), "query_id").join(store.select("user_id", "seq", _words(F.col("text")).alias("rw")), ["user_id", "seq"])
    return both.select("query_id", "user_id", "seq", F.size(F.array_intersect("qw", "rw")).cast("long").alias("score"))


def essential_tokens(store: DataFrame, postings: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, user_id, word, left_out, floor): the tokens of each query that the join needs, how many it can do without, and a lower bound of its k-th best score."""
    return _bounded_tokens(store, postings, queries, k).filter(F.col("nth") <= F.col("tokens") - F.col("left_out")).select("query_id", "user_id", "word", "left_out", "floor")


def _bounded_tokens(store: DataFrame, postings: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, user_id, word, nth, tokens, left_out, floor): all tokens of each query that its user's store holds, the rarest first."""
    asked = queries.select("query_id", "user_id", F.explode(_words(F.col("query"))).alias("word"))
    often = postings.join(lineage.small(asked.select("user_id", "word").distinct()), ["user_id", "word"], "left_semi").groupBy("user_id", "word").agg(F.count(F.lit(1)).alias("df"))
    tokens = asked.join(often, ["user_id", "word"])
    rare = F.row_number().over(Window.partitionBy("query_id").orderBy("df", "word"))
    tokens = lineage.cut(tokens.select("query_id", "user_id", "word", rare.alias("nth"), F.count(F.lit(1)).over(Window.partitionBy("query_id")).alias("tokens")))
    rarest = tokens.filter(F.col("nth") <= SEEDS)
    first = F.row_number().over(Window.partitionBy("user_id", "word").orderBy("seq"))  # every task passes on SEED_RECORDS of a word at most
    heads = postings.join(lineage.small(rarest.select("user_id", "word").distinct()), ["user_id", "word"], "left_semi")
    heads = heads.withColumn("_n", first).filter(F.col("_n") <= SEED_RECORDS).drop("_n")
    some = rarest.join(heads, ["user_id", "word"]).select("query_id", "user_id", "seq").distinct()
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc()))
    floors = _in_full(store, queries, some).withColumn("_n", best).filter(F.col("_n") == k).select("query_id", F.col("score").alias("floor"))
    bound = tokens.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0)))
    return bound.withColumn("left_out", F.least(F.greatest(F.col("floor") - 1, F.lit(0)), F.col("tokens")))


def flatten_facts(nested: str = "facts"):
    """Lists of facts that a model returned nested, flattened by one level."""
    return F.flatten(nested)
