"""Single-process pandas versions of one operator of each family, timed beside the engine's; prints one JSON line.

Files are read by both sides. The engine runs on local[$BENCH_CPUS] after a warm-up, pandas on one core.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pandas as pd

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")


def read(name: str, columns: list[str] | None = None) -> pd.DataFrame:
    return pd.read_parquet(f"{SF_DIR}/{name}.parquet", columns=columns)


def bars() -> pd.DataFrame:
    l, s = read("lineitem", ["l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"]), read("supplier", ["s_suppkey", "s_nationkey"])
    x = l.merge(s, left_on="l_suppkey", right_on="s_suppkey")
    x["p"], x["d"] = x["l_extendedprice"].astype(float) / x["l_quantity"].astype(float), pd.to_datetime(x["l_shipdate"]).astype("datetime64[us]")
    x["ts"] = x["d"] - pd.to_timedelta(x["d"].dt.weekday, unit="D")
    x = x.sort_values(["s_nationkey", "ts", "d", "l_orderkey", "l_linenumber"])
    g = x.groupby(["s_nationkey", "ts"], sort=True)
    return g.agg(open=("p", "first"), high=("p", "max"), low=("p", "min"), close=("p", "last"), volume=("l_quantity", "sum")).reset_index()


def returns() -> int:
    b = bars()
    g = b.groupby("s_nationkey")["close"]
    for k in (1, 3, 5, 20, 60):
        b[f"r{k}"] = g.pct_change(k).fillna(0.0)
    return len(b)


def asof() -> int:
    b, o, c = bars(), read("orders", ["o_custkey", "o_orderdate", "o_orderkey"]), read("customer", ["c_custkey", "c_nationkey"])
    o = o.merge(c, left_on="o_custkey", right_on="c_custkey")
    o["at"] = pd.to_datetime(o["o_orderdate"]).astype("datetime64[us]")
    b["ts"] = b["ts"].astype("datetime64[us]")
    return len(pd.merge_asof(b.sort_values("ts"), o.sort_values(["at", "o_orderkey"]), left_on="ts", right_on="at", left_by="s_nationkey", right_by="c_nationkey"))


def daily_ic() -> int:
    b = bars()
    b["y"] = b.groupby("s_nationkey")["close"].shift(-1) / b.groupby("s_nationkey")["open"].shift(-1) - 1
    b["score"] = b["close"] - b["open"]
    b = b.dropna(subset=["y"])
    return sum(1 for _, d in b.groupby("ts") if len(d) > 1 and (d["score"].corr(d["y"]), d["score"].rank().corr(d["y"].rank())))


def tone() -> int:
    from tidemark.functions import text as T

    words, token = T.POSITIVE | T.NEGATIVE, re.compile(r"[^\W_]+(?:'[^\W_]+)?")
    total = 0.0
    for t in read("documents", ["text"])["text"]:
        toks = token.findall(unicodedata.normalize("NFKC", t or "").casefold())
        for i, w in enumerate(toks):
            if w in words:
                total += -words[w] if sum(x in T.NEGATIONS for x in toks[max(0, i - 3): i]) % 2 else words[w]
    return int(total)


def search() -> int:
    items = read("benchmark")
    grams = lambda t: Counter(x[i: i + n] for x in [" ".join(t.lower().split())] for n in range(2, 6) for i in range(len(x) - n + 1))
    index = {i: grams(t) for i, t in zip(items["item_id"], items["text"])}
    often, postings = Counter(g for c in index.values() for g in c), defaultdict(list)
    for i, c in index.items():
        size = sum(c.values())
        for g, k in c.items():
            postings[g].append((i, k / size))
    out = 0
    for q in (i for i in index if i % 20 == 0):
        score: dict = defaultdict(float)
        for g, k in index[q].items():
            weight = k * (np.log((1 + len(index)) / (1 + often[g])) + 1)
            for i, tf in postings[g]:
                score[i] += weight * tf
        out += len(sorted(score, key=lambda i: (-round(score[i], 9), i))[:10])
    return out


def exact_hash() -> int:
    return len({hashlib.sha256(" ".join((t or "").casefold().split()).encode()).hexdigest() for t in read("documents", ["text"])["text"]})


def exact_topk() -> int:
    v = read("embeddings")
    m = np.floor(256 * np.stack(v["embedding"].to_numpy()).astype(float))
    ids = v["vec_id"].to_numpy()
    return sum(len(np.lexsort((ids, -(m @ q)))[:6]) for q in m[ids % 50 == 0])


FAMILIES = {"W01_returns": returns, "J06_backward_asof": asof, "A16_daily_ic": daily_ic, "C05_sentiment": tone, "G03_tfidf_search": search, "C02_exact_hash": exact_hash, "op1_exact_topk": exact_topk}


def main() -> None:
    import bench

    took = {}
    for name, f in FAMILIES.items():
        began = time.time()
        f()
        took[name] = time.time() - began
    ours = bench.measure(list(FAMILIES))
    print(json.dumps({n: {"pandas": round(s, 3), "engine": ours[n], "pandas_over_engine": round(s / ours[n], 2)} for n, s in took.items() if n in ours}))


if __name__ == "__main__":
    main()
