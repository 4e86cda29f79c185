import math
from datetime import date

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import calendars, core, costs
from tidemark.functions import text as T


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_finite_and_return(spark):
    values = [("1.5", 1.5), ("x", 0.0), (None, 0.0), ("nan", 0.0), ("inf", 0.0), ("-3", -3.0)]
    df = spark.createDataFrame([(v,) for v, _ in values], "v string").select(core.finite(F.col("v")).alias("f"))
    assert [r.f for r in df.collect()] == [f for _, f in values]
    assert one(spark, core.simple_return(F.lit(3.0), F.lit(0.0)).alias("r")).r == 0.0
    assert one(spark, core.slug(F.lit("--A b/C--")).alias("s"), core.slug(F.lit("??")).alias("o")) == ("a_b_c", "other")


def test_correlation_is_zero_for_a_constant(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert df.agg(core.correlation(F.col("x"), F.col("y")).alias("c")).first().c == 0.0


def test_average_rank(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (2.0,), (3.0,)], "x double").withColumn("g", F.lit(1))
    w = Window.partitionBy("g")
    r = df.select(core.average_rank(F.col("x"), w, w.orderBy("x"), Window.partitionBy("g", "x")).alias("r")).collect()
    assert sorted(x.r for x in r) == [0.5, 0.5, 2.0, 3.0]


def plain_sentiment(tokens):
    words = T.POSITIVE | T.NEGATIVE
    hits, doubts = [], sum(t in T.UNCERTAIN for t in tokens)
    for i, t in enumerate(tokens):
        if t in words:
            odd = 0
            for p in reversed(tokens[max(0, i - 3): i]):
                if p in T.BREAKERS or p in words:
                    break
                odd += p in T.NEGATIONS
            hits.append(-words[t] if odd % 2 else words[t])
    u = min(1.0, doubts / max(1, len(hits) + doubts))
    if not hits:
        return 0.0, 0.0
    raw = sum(hits) / sum(map(abs, hits))
    return max(-1.0, min(1.0, raw * (1 - 0.35 * u))), min(1.0, (0.2 + 0.55 * abs(raw) + 0.25 * min(1.0, len(hits) / 3)) * (1 - 0.5 * u))


@pytest.mark.parametrize("text", ["profits beat strong growth", "not strong", "never not strong but weak", "no growth may be possible loss", "not a big loss", "without however growth",
                                  "hardly any risk", "the weak not profit", "not not not strong", ""])
def test_sentiment(spark, text):
    s = one(spark, T.sentiment(T.tokens(F.lit(text))).alias("s")).s
    score, sure = plain_sentiment(text.split())
    assert math.isclose(s.score, score, abs_tol=1e-12)
    assert sure == 0.0 or math.isclose(s.confidence, sure, abs_tol=1e-12)


def test_preprocess(spark):
    texts = ["Ａｌｐｈａ gains 🚀 https://example.test/story, @Trader #Growth $AAA\nRead more", None, "", "Straße ΣΑΣ #Größe #größe — it's ½ ﬁt\r\n\x0b ...Privacy Policy: x\nread mores? " + "y" * 160,
             "A CEO of BRK.B and $brk.b, $BRK.B $toolongtickername a@b @@c #a_b ##c WWW.X.org/(z) ☀️👩‍💻 www.y.z!!", "no\u2028copyright 2020\u2029yes"]
    p = [r.p for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(T.preprocess("t").alias("p")).collect()]
    assert p[0].cashtags == ["AAA"] and p[0].urls == ["https://example.test/story"] and p[0].mentions == ["trader"] and p[0].hashtags == ["growth"] and p[0].emojis == ["🚀"]
    assert p[0].normalized == "alpha gains <emoji> <url> <mention> growth $aaa" and p[0].tokens == ["alpha", "gains", "<emoji>", "<url>", "<mention>", "growth", "$aaa"]
    assert all(x.normalized == "" and x.tokens == [] and x.tickers == [] for x in p[1:3])
    assert p[3].hashtags == ["grösse"] and p[3].normalized.startswith("strasse σασ grösse grösse — it's 1⁄2 fit read mores? yyy") and p[3].tokens[3:7] == ["grösse", "it's", "1", "2"]
    assert p[4].cashtags == ["BRK.B"] and p[4].tickers == ["BRK.B", "WWW.X"] and p[4].mentions == [] and p[4].hashtags == ["a"] and p[4].emojis == ["☀", "👩", "💻"]
    assert p[4].normalized == "a ceo of brk.b and $brk.b, $brk.b $toolongtickername a@b @@c a _b ##c <url> (z) <emoji> <emoji> <emoji> <url>"
    assert p[4].urls == ["WWW.X.org/", "www.y.z"] and p[5].normalized == "no yes"



def test_spans_chunks_ngrams(spark):
    r = one(spark, T.sentence_spans(F.lit("One two. Three!\nFour")).alias("s"), T.chunks(F.lit("abcde"), 2).alias("c"), T.char_ngrams(F.lit("ab"), 2, 5).alias("g"), T.chunks(F.lit(""), 2).alias("e"))
    assert [(x.id, x.text) for x in r.s] == [("S1", "One two."), ("S2", "Three!"), ("S3", "Four")]
    assert [(x.start, x.end, x.text) for x in r.c] == [(0, 2, "ab"), (2, 4, "cd"), (4, 5, "e")] and r.g == ["ab"] and r.e == []


def test_calendars(spark):
    ny = {r.session_date: r for r in calendars.sessions(spark, "XNYS", date(2026, 6, 1), date(2026, 12, 31)).collect()}
    assert date(2026, 7, 3) not in ny and date(2026, 11, 26) not in ny
    assert ny[date(2026, 11, 27)].close_utc.hour == 18 and ny[date(2026, 11, 27)].early_close
    assert (ny[date(2026, 7, 8)].open_utc.hour, ny[date(2026, 7, 8)].open_utc.minute) == (13, 30)
    jp = {r.session_date: r for r in calendars.sessions(spark, "XJPX", date(2024, 10, 1), date(2026, 12, 31)).collect()}
    assert date(2026, 7, 20) not in jp and jp[date(2026, 7, 21)].open_utc.hour == 0
    assert (jp[date(2026, 7, 21)].close_utc.hour, jp[date(2026, 7, 21)].close_utc.minute) == (6, 30) and jp[date(2024, 11, 1)].close_utc.hour == 6


def test_costs(spark):
    c = costs.CostModel(1, 2, 3, 365, 0, 0, 0).columns(F.lit(-0.5), F.lit(0.1), F.lit(0.2), F.lit(-0.4), F.lit(10.0))
    r = one(spark, *(v.alias(k) for k, v in c.items()))
    assert math.isclose(r.commission, 0.5e-4) and math.isclose(r.borrow, 0.4 * 365e-4 * 10 / 365) and math.isclose(r.total, 0.5 * 6e-4 + r.borrow)
    with pytest.raises(ValueError):
        costs.CostModel(commission_bps=-1)


def test_few_texts_are_python_objects_at_once():
    """Of a batch of texts, most stay in Arrow while a few are composed or folded."""
    import tracemalloc

    import pyarrow as pa

    texts = pa.array([f"Straße {i} " * 200 for i in range(3000)])
    lists = pa.ListArray.from_arrays(pa.array(range(3001), pa.int32()), texts)
    for of, batch in ((T.nfkc.func, texts), (T.folded.func, lists)):
        tracemalloc.start()
        out = of(batch)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(out) == 3000 and peak < texts.nbytes / 3
    assert out[7].as_py() == ["strasse 7 " * 200]
