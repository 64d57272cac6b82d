import json
import random

import duckdb
import pytest

from tessera.llm import preferences as P
from tessera.llm import queries

RNG = random.Random(9)


def brute(rows):
    """rows: (conv_id, turn, role, text)."""
    pairs = {}
    for c, t, r, x in rows:
        pairs.setdefault(None if c is None else c // 2, ([], []))[0 if c is None else c % 2].append(((t is not None, t or 0), r or "", x or ""))
    out = {}
    for k, (a, b) in pairs.items():
        a, b = ([(r, x) for _, r, x in sorted(s)] for s in (a, b))
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        text = lambda s: "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in s)
        spans = []
        for s in (a[n:], b[n:]):
            whole, own = text(s), []
            at = 0
            for r, x in s:
                size = len(text([(r, x)]))
                if r == "assistant":
                    own.append((at + len(f"<|im_start|>{r}\n"), at + size - 1))
                at += size
            assert at == len(whole)
            spans.append(own)
        out[k] = (n, text(a[:n]), text(a[n:]), text(b[n:]), *spans)
    return out


def make():
    rows = []
    for c in range(60):
        turns = [("user" if t % 2 == 0 else "assistant", RNG.choice(["hi", "é🙂", "", "what now?"])) for t in range(RNG.randint(0, 6))]
        if c % 2 and RNG.random() < 0.7:
            own = [x for x in rows if x[0] == c - 1]
            k = RNG.randint(0, len(own))
            turns = [(r, x) for _, _, r, x in own[:k]] + turns[:2]
        rows += [(c, t, r, x) for t, (r, x) in enumerate(turns)]
    return rows


def test_brute(spark):
    rows = make() + [(100, 0, None, "x"), (101, None, "user", None), (None, 1, "user", "lost"), (104, 0, "user", "y"), (104, 0, "assistant", "y" * 50_000), (104, 0, "user", "y")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, prompt string")
    got = P.preferences(P.paired(df), "_pair", "_side").collect()
    pair = lambda s: [(x.begin, x.end) for x in s]
    assert {r.pair_id: (r.n_shared, r.prompt, r.chosen, r.rejected, pair(r.chosen_spans), pair(r.rejected_spans)) for r in got} == brute(rows)
    assert P.preferences(P.paired(df.limit(0)), "_pair", "_side").count() == 0


def test_turns_without_a_pair_stay_apart(spark):
    rows = [(None, 0, 1, "user", "a"), (None, 0, 2, "assistant", "b"), (None, 1, 1, None, None), (None, None, 1, "user", "no side"), (None, 0, 1, "user", "a")]
    got = P.preferences(spark.createDataFrame(rows, "p long, s int, turn int, role string, text string"), "p", "s").collect()
    out = lambda r, t: f"<|im_start|>{r}\n{t}<|im_end|>\n"
    want = [(None, 0, "", out("user", "a"), "")] * 2 + [(None, 0, "", out("assistant", "b"), ""), (None, 0, "", "", out("", ""))]
    assert sorted([tuple(r)[:5] for r in got], key=str) == sorted(want, key=str)


def test_oracle(spark, tmp_path):
    rows = make()
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.QUERIES["op10_preference_formatting"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(queries.ORACLES["op10_preference_formatting"])
    names = [d[0] for d in want.description]
    assert names == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    assert all(json.loads(r[5]) is not None for r in got.take(3))
