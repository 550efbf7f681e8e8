import random
import re
import unicodedata

from pyspark.sql import functions as F

from mnemoframe.functions import text as X

SAMPLES = ["", "  ", "User has a peanut-allergy!", "मुझे मूंगफली से एलर्जी है।", "Straße_und__Bär", "é  　x", "क़लम", "²½ Ⅷ x_y", "tabs\tand\nlines", "ABC's"]


def plain_normalize(t):
    t = unicodedata.normalize("NFC", t.lower()).replace("_", " ")
    return " ".join(re.sub(r"[^\w\s]", " ", t).split())


def ask(spark, column, values, schema="t string"):
    return [r.x for r in spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], schema).select(column.alias("x")).collect()]


def test_normalize(spark):
    assert ask(spark, X.normalize(F.col("t")), SAMPLES) == [plain_normalize(t) for t in SAMPLES]


def test_strict_match_reduces_to_one_substring(spark):
    """The key against a restatement with both plural forms and word boundaries."""

    def restated(target, text):
        c, t = plain_normalize(text), plain_normalize(target)
        if not t:
            return False
        forms = [t] + ([t[:-1]] if t.endswith("s") and len(t) > 3 else [t + "s"] if len(t) > 2 else [])
        return any(re.search(r"\b" + re.escape(f) + r"\b", c) or f in c for f in forms)

    rng = random.Random(1)
    word = lambda: "".join(rng.choice("ass b.'") for _ in range(rng.randrange(7)))
    pairs = [(word(), " ".join(word() for _ in range(4))) for _ in range(400)] + [("peanuts", "User has peanut allergy"), ("car", "a card"), ("s", "sss")]
    assert ask(spark, X.strict_match(F.col("x"), F.col("t")), pairs, "t string, x string") == [restated(*p) for p in pairs]


def test_tokens_keep_marks(spark):
    assert ask(spark, X.tokens(F.col("t")), ["मुझे क़लम!", "", "a_b"]) == [" मुझे कलम ", "  ", " a b "]


def test_half_even(spark):
    rng = random.Random(2)
    numbers = [0.0625, 0.1875, 0.0005, 0.0015, 2.675, -0.0625, 0.0, 1e-9, 123456.7895, 0.5, 1 / 3] + [rng.uniform(-50, 50) for _ in range(300)] + [rng.randrange(-4000, 4000) / 16 for _ in range(200)]
    assert ask(spark, X.half_even(F.col("t")), numbers, "t double") == [f"{abs(x) if x == 0 else x:.3f}" for x in numbers]


def test_half_even_at_the_ends(spark):
    """Negative zeros, numbers beyond seventeen digits, what is no number, and null."""
    rng = random.Random(4)
    inf = float("inf")
    numbers = [-0.0, -1e-9, 5e-324, 803372835579624.0, 2.0**50 + 0.25, -(2.0**52) - 0.5, 2.0**53 + 2, -4.658643736660667e18, 1e22, 1.7e308, -inf, inf, float("nan")] + [rng.uniform(-1, 1) * 10.0 ** rng.randrange(12, 40) for _ in range(300)]
    assert ask(spark, X.half_even(F.col("t")), numbers, "t double") == [f"{x:.3f}" for x in numbers]
    assert ask(spark, X.mean_and_std(F.col("t"), F.lit(1.0)), [None, -0.0], "t double") == [None, "-0.000 ± 1.000"]


def test_entailment_by_a_scorer(spark):
    import pandas as pd

    @F.pandas_udf("double")
    def model(premise: pd.Series, hypothesis: pd.Series) -> pd.Series:
        return pd.Series([None if p == "none" else len(h) / 10 for p, h in zip(premise, hypothesis)], dtype="float64")

    pairs = [("a", "1234567"), ("a", "123456"), (" \n\xa0", "1234567"), ("a", " \t       "), ("none", "1234567"), (None, "1234567"), ("a", None)]
    assert ask(spark, X.entails(F.col("p"), F.col("h"), scorer=model), pairs, "p string, h string") == [True] + [False] * 6
    assert ask(spark, X.entails(F.col("p"), F.col("h"), 0.6, model), pairs, "p string, h string") == [True, True] + [False] * 5
    native = lambda p, h: F.length(h) / 10
    assert ask(spark, X.entails(F.col("p"), F.col("h"), scorer=native), pairs[:4], "p string, h string") == [True, False, False, False]


def test_small_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(X.capitalize(F.lit("my mother's"))) == "My mother's"
    assert one(X.fill(F.lit("{Poss} dish is {v}, {poss}"), F.lit("my"), v=F.lit("dal"))) == "My dish is dal, my"
    assert one(X.entity_stem(F.lit("user_sister"))) == "sister" and one(X.entity_stem(F.lit("user"))) == "user"
    assert one(X.token_overlap(F.lit("A b, c"), F.lit("a b c c"))) == 2
    assert one(X.entails(F.lit("i like dogs"), F.lit("dogs like cats me"))) is True
    assert one(X.entails(F.lit("x"), F.lit("  !"))) is False
    assert one(X.first_filled(F.lit(""), F.lit(None).cast("string"), F.lit("z"))) == "z"
    assert one(X.mock_response(F.lit("p" * 40))) == "[MOCK_RESPONSE to: " + "p" * 30 + "...]"
    assert one(X.fallback_probe(F.lit("lives_in"), "hi-en")) == "User ke lives_in ke baare me kya pata hai?"
    assert one(X.fallback_probe(F.lit("lives_in"), "hi-en", transliterated=False)) == "What is the user's lives in?"
