"""Text functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode letters and numbers: what Python's \w holds besides the underscore (no combining marks).
_NOT_WORD = r"[^\p{L}\p{N}]+"
_NOT_WORD_OR_MARK = r"[^\p{L}\p{N}\p{M}]+"
_NUKTA = "़"


def nfc(text: Column) -> Column:
    """Unicode NFC, by the ICU library that Spark ships; ASCII, on which it does nothing, does not pay for the call."""
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))
    return F.when(text.rlike(r"[^\x00-\x7f]"), composed).otherwise(text)


def normalize(text: Column) -> Column:
    """Lower case, NFC, and anything but letters and numbers as one blank; combining marks go, as in Python's \\w."""
    return F.trim(F.regexp_replace(nfc(F.lower(text)), _NOT_WORD, " "))


def match_key(text: Column) -> Column:
    """The one string whose occurrence in a normalised text decides whether ``text`` or its s-plural occurs; empty never matches."""
    n = normalize(text)
    return F.when(n.endswith("s") & (F.length(n) > 3), F.substring(n, F.lit(1), F.length(n) - 1)).otherwise(n)


def match_keys(*texts: Column) -> Column:
    """Distinct non-empty keys of an array expression."""
    return F.array_distinct(F.filter(F.transform(F.concat(*texts), match_key), lambda k: k != ""))


def contains_any(normal: Column, keys: Column) -> Column:
    """Whether a normalised text holds any of the keys."""
    return F.exists(keys, lambda k: F.contains(normal, k))


def strict_match(text: Column, *targets: Column) -> Column:
    return contains_any(normalize(text), match_keys(F.array(*targets)))


def tokens(text: Column) -> Column:
    """Lower-case tokens between single blanks, one in front and one behind; keeps combining marks, drops the nukta."""
    plain = F.replace(nfc(F.lower(text)), F.lit(_NUKTA), F.lit(""))
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(plain, _NOT_WORD_OR_MARK, " ")), F.lit(" "))


def words(text: Column) -> Column:
    """White-space tokens, without empty ones."""
    return F.array_remove(F.split(text, r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"), "")


def token_overlap(query: Column, text: Column) -> Column:
    """Number of distinct lower-case white-space tokens in common; punctuation stays."""
    return F.size(F.array_intersect(words(F.lower(query)), words(F.lower(text))))


def entails(premise: Column, hypothesis: Column, threshold: float | None = None, scorer: Callable[[Column, Column], Column] | None = None) -> Column:
    """Whether a score of the pair reaches a threshold; blank texts entail nothing.

    ``scorer`` makes the score from the two columns: a model goes in as a pandas UDF, its threshold is 0.7.
    Without one the score is the share of the hypothesis' distinct normalised tokens that the premise has, against 0.5.
    A pair without a score is not entailed.
    """
    if scorer is not None:
        p, h = F.coalesce(premise, F.lit("")), F.coalesce(hypothesis, F.lit(""))
        filled = (F.size(words(p)) > 0) & (F.size(words(h)) > 0)
        return F.coalesce(filled & (scorer(p, h) >= (0.7 if threshold is None else threshold)), F.lit(False))
    threshold = 0.5 if threshold is None else threshold
    split = lambda t: F.array_distinct(F.array_remove(F.split(normalize(t), " "), ""))
    p, h = split(premise), split(hypothesis)
    return (F.size(h) > 0) & (F.size(p) > 0) & (F.coalesce(F.try_divide(F.size(F.array_intersect(p, h)), F.size(h)), F.lit(0.0)) >= threshold)


def capitalize(text: Column) -> Column:
    """The first character in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 2_147_483_647))


def fill(template: Column, possessor: Column, **slots: Column) -> Column:
    """A template with {poss}, {Poss} and the given slots replaced."""
    out = F.replace(F.replace(template, F.lit("{poss}"), possessor), F.lit("{Poss}"), capitalize(possessor))
    for name, value in slots.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def entity_stem(entity: Column) -> Column:
    return F.replace(entity, F.lit("user_"), F.lit(""))


def first_filled(*options: Column) -> Column:
    """The first option that is neither null nor empty, else an empty text."""
    return F.coalesce(*[F.nullif(o, F.lit("")) for o in options], F.lit(""))


def half_even(number: Column) -> Column:
    """A double with three places, rounded half to even on its exact binary value (Spark's own formatting rounds half up).

    The double is taken apart into sign, mantissa and exponent; a thousand times the mantissa still fits a long.  From 2^50 on three
    places are exact.  The sign is the bit's, as in C: a negative zero keeps it.  Null gives null.
    """
    size = F.abs(number)
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), size).cast("long")
    exponent = F.shiftright(bits, 52)
    m = bits.bitwiseAND(F.lit((1 << 52) - 1)) + F.when(exponent > 0, F.lit(1 << 52)).otherwise(0)
    s = F.least(F.lit(62), F.lit(1075) - F.greatest(exponent, F.lit(1))).cast("int")
    thousand = m * 1000
    q = F.call_function("shiftright", thousand, s)
    rest, half = thousand - F.call_function("shiftleft", q, s), F.call_function("shiftleft", F.lit(1).cast("long"), s - 1)
    q = F.when(F.lit(1075) - exponent > 63, F.lit(0)).when(F.lit(1075) - exponent == 63, (thousand > (1 << 62)).cast("long")).otherwise(q + ((rest > half) | ((rest == half) & (q % 2 == 1))).cast("long"))
    small = F.concat(F.call_function("div", q, F.lit(1000)).cast("string"), F.lit("."), F.lpad((q % 1000).cast("string"), 3, "0"))
    exact = F.reflect(F.lit("scala.math.BigDecimal"), F.lit("exact"), size)  # all digits; Spark's casts keep seventeen
    large = F.concat(F.substring_index(exact, ".", 1), F.lit("."), F.rpad(F.when(F.contains(exact, F.lit(".")), F.substring_index(exact, ".", -1)).otherwise(""), 3, "0"))
    infinity = F.lit(float("inf"))
    # of the zeros only the negative one is written with a sign
    sign = F.when((number < 0) | ((number == 0) & number.cast("string").startswith("-")), "-").otherwise("")
    text = F.when(size < 2.0**50, small).when(size < infinity, large).when(size == infinity, "inf").otherwise("nan")
    return F.when(number.isNotNull(), F.concat(sign, text))


def mean_and_std(mean: Column, std: Column) -> Column:
    return F.concat(half_even(mean), F.lit(" ± "), half_even(std))


def fallback_probe(relation: Column, lang: str, again: bool = False, transliterated: bool = True) -> Column:
    """The question asked where none was written.  Re-probes and the retrieval probe have no transliterated form."""
    spaced = F.replace(relation, F.lit("_"), F.lit(" "))
    # fixed texts
    if lang == "hi":
        return F.concat(F.lit("यूज़र के "), relation, F.lit(" के बारे में अब क्या जानकारी है?" if again else " के बारे में क्या जानकारी है?"))
    if lang == "hi-en" and transliterated and not again:
        return F.concat(F.lit("User ke "), relation, F.lit(" ke baare me kya pata hai?"))
    return F.concat(F.lit("What is the user's current " if again else "What is the user's "), spaced, F.lit("?"))


def mock_embedding_seed(text: Column) -> Column:
    """A repeatable seed for a text's mock embedding."""
    return F.xxhash64(text)


def mock_response(prompt: Column) -> Column:
    return F.concat(F.lit("[MOCK_RESPONSE to: "), F.substring(prompt, 1, 30), F.lit("...]"))
