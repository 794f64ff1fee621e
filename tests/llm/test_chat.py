"""Chat trees: exact round trip, shared nodes once, positions and ancestors."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from statuta.llm import chat

ROWS = [
    (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 0, None, None), (1, 1, "tool>>x", "a\\b <<ROLE x>> \\"), (1, 1, "tool>>x", "a\\b <<ROLE x>> \\"),
    (2, 0, "user", "hi"), (2, 1, "assistant", ""), (3, 0, "user", "hi"), (3, 1, "assistant", "yo "), (3, 2, "assistant", " \n yo[]\\\\<"), (4, 0, "user", "hi"), (4, 1, "assistant", ""),
    (5, 0, "system", "be kind"), (5, 1, "user", "hi"), (5, 2, "assistant", "é" * 400), (None, 0, "user", "no id"),
]


def test_conversations_come_back_exactly(spark):
    df = spark.createDataFrame([(*r, 1) for r in ROWS], "conv_id long, turn long, role string, text string, node int")
    nodes, index = chat.build(df)
    got = {r.conv_id: r for r in chat.read_back(nodes, index).collect()}
    talks = {}
    for r in ROWS:
        talks.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    assert set(got) == set(talks)
    for k, turns in talks.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        r = got[k]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    rows = nodes.orderBy("start").collect()
    prefixes = {tuple(t[: i + 1]) for t in talks.values() for i in range(len(t))}
    assert len(rows) == len(prefixes)  # every shared beginning once
    at = 0
    for r in rows:
        assert r.start == at and r.position_ids == list(range(r.position_ids[0], r.position_ids[0] + len(r.token_ids)))
        assert sum(s["to"] - s["from"] for s in r.ancestors) == r.position_ids[0] and all(s["to"] <= r.start for s in r.ancestors)
        at += len(r.token_ids)


def test_first_turn_that_all_share(spark):
    """One turn before all others, whole conversations that repeat, and an answer of a million characters."""
    rows = [(c, t, role, text) for c in range(3000) for t, role, text in ((0, "system", "be kind"), (1, "user", f"q{c % 1500}"))] + [(9999, 0, "assistant", "long </s> " * 100_000)]
    nodes, index = chat.build(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert nodes.count() == 1502 and nodes.where("depth = 1 AND size(ancestors) = 1").count() == 1500
    got = {r.conv_id: r for r in chat.read_back(nodes, index).collect()}
    assert len(got) == 3001 and got[9999].loss_chars == 1_000_000
    assert all(got[c].turns_sha256 == hashlib.sha256(f"system\nbe kind\nuser\nq{c % 1500}\n".encode()).hexdigest() for c in range(3000))


def test_hot_keys_are_joined_in_parts(spark):
    from statuta.llm.common import join_salted

    rows = spark.range(5000).selectExpr("id AS g", "CASE WHEN id % 3 = 0 THEN id ELSE -1 END AS k")
    others = spark.range(-1, 6000).selectExpr("id AS k", "id * 2 AS v")
    got = join_salted(rows, others, ["k"], "g")
    assert sorted(map(tuple, got.select("g", "k", "v").collect())) == [(g, k, 2 * k) for g in range(5000) for k in [g if g % 3 == 0 else -1]]
    assert sum("salt" in c for c in got.columns) == 0 and join_salted(rows.limit(0), others, ["k"], "g").count() == 0


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(*chat.build(df)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "x>>y", "\\"]), st.text(alphabet=st.sampled_from("\\<[]/>sINT SYRO\n"), max_size=20))))
def test_template_can_be_parsed_whatever_the_text(turns):
    assert chat.parse("".join("".join(chat.segments(*t)) for t in turns)) == turns
