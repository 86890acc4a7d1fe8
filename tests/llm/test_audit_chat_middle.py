"""Operators 11 to 13 against brute force: filter audit, chat formatting, fill-in-middle."""

import hashlib
import json
import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from pixelframe.llm.chat_format import LAYOUTS, Layout, Template, chat_turns, conversations_of, field_paths, parsed, read_back
from pixelframe.llm.fill_middle import CHARS, LINES, WORDS, Plan, fill_middle, rebuilt, restored, runs
from pixelframe.llm.filter_audit import filter_audit, interaction_audit

DOCS = "doc_id long, text string, lang string, A string, first boolean, good int, place string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", True, 7, "y") for i, t, lang in rows], DOCS)


def _failed(rows):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        upper = sum("A" <= c <= "Z" for c in t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * upper > 3 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > least[t]}
        yield i, lang or "", {k for k, v in f.items() if v}


def _audited(rows, labels):
    quality = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    failed, out = list(_failed(rows)), {}
    for part in {p for _, p, _ in failed}:
        own = [(i, f) for i, p, f in failed if p == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for step, k in enumerate(order, 1):
                seen, now = set(order[: step - 1]), set(order[:step])
                removed = [i for i, f in own if k in f and not f & seen]
                total[k] += len(removed)
                out[part, "".join(order), step] = [
                    sum(not f & now for _, f in own), len(removed), sum(k in f and bool(f & seen) for _, f in own), sum(f == {k} for _, f in own),
                    sum(i in quality for i in removed), sum(i in toxic for i in removed),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def test_audit_is_brute_force_with_odd_rows(spark):
    rng = random.Random(5)
    long = " ".join(f"w{i}" for i in range(250))
    texts = [None, "", "  ", "\t a\vb\f", "Aa", "###", long, long + " #", long.upper(), "x " * 300, "x\u00a0y é" * 120, "same text", "same text "]
    rows = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice([None, "", "en", "de"])) for _ in range(150)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [None, *range(30), 3, 4, 99]]
    out = filter_audit(_docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in out}
    assert got == _audited(rows, labels) and len(out) == len(got)


def test_audit_of_an_empty_table_and_of_other_filters(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit(_docs(spark, []), labels).collect() == []
    rows = spark.createDataFrame([("p", True, True, 1), ("p", True, False, 0), ("p", False, False, 1)], "part string, x boolean, y boolean, m int")
    out = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.m_lost, r.shapley) for r in interaction_audit(rows, ["x", "y"], ["m"]).collect()}
    assert out == {("xy", 1): (1, 2, 0, 1, 1, 3), ("xy", 2): (1, 0, 1, 0, 0, 1), ("yx", 1): (2, 1, 0, 0, 1, 1), ("yx", 2): (1, 1, 1, 1, 0, 3)}
    with pytest.raises(ValueError):
        interaction_audit(rows, [], []).collect()


def test_repeats_send_one_row_a_task(spark):
    plan = filter_audit(_docs(spark, [(1, "a", "en")]), spark.createDataFrame([], "doc_id long, quality int, toxic int"))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "PythonUDF" not in plan and "MapInArrow" not in plan


TRICKY = ["", None, "\\", "\\\\", "<turn>", "</turn>", "\\b", "\\e\\", "<tu</turn>rn>", "### Assistant: ok", "a\nb", "\n", "é😀</turn", "<turn>user\nhi</turn>", "\\</turn>\\"]


def test_chats_come_back_and_masks_hold_what_assistants_say(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 2, 3, -9]), rng.choice([None, 0, 1, 2, 3]), rng.choice(["user", "assistant", None, "", "a\nb", "<turn>", "\\r"]), rng.choice(TRICKY)) for _ in range(120)]
    rows += [(7, t, "assistant", "again") for t in (0, 0)] + [(None, 0, "assistant", "x"), (None, 0, "assistant", "x")]
    df = spark.createDataFrame([(*r, "k", "t", 5) for r in rows], "conv_id long, turn long, role string, text string, _key string, Turns string, layout int")
    out = read_back(conversations_of(df)).collect()
    got = sorted((r.conv_id, [(t.role, t.text) for t in r.turns], r.loss_text) for r in out if r.conv_id is not None)
    want = []
    for c in sorted({r[0] for r in rows} - {None}):
        own = sorted((-1 if t is None else t, role or "", text or "") for i, t, role, text in rows if i == c)
        want.append((c, [(r, t) for _, r, t in own], "".join(t for _, r, t in own if r == "assistant")))
    assert got == want
    assert [(r.formatted, r.loss_text) for r in out if r.conv_id is None] == [("<turn>assistant\nx</turn>", "x")] * 2
    assert conversations_of(df.limit(0)).collect() == []


def test_a_long_conversation_and_another_template(spark):
    df = spark.range(20_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("[END]\n; "), F.col("id")).alias("text"))
    template = Template(begin="[#", between=": ", end="[END]\n")
    (r,) = read_back(conversations_of(df, template=template), template=template).collect()
    assert [t.text for t in r.turns] == [f"[END]\n; {i}" for i in range(20_000)]
    assert r.loss_text == "".join(f"[END]\n; {i}" for i in range(1, 20_000, 2))
    for bad in ({"begin": "x", "end": "x"}, {"begin": "<<"}, {"end": "\\"}, {"between": ""}):
        with pytest.raises(ValueError):
            Template(**bad)


RECORDS = {
    '{"id": 1, "prompt": "p", "completion": "c"}': ("prompt", [("user", "p"), ("assistant", "c")]),
    '{"id": 2, "system": "s", "prompt": "p", "completion": "c"}': ("prompt", [("system", "s"), ("user", "p"), ("assistant", "c")]),
    '{"id": 3, "prompt": "p", "response": "r"}': ("response", [("user", "p"), ("assistant", "r")]),
    '{"id": 4, "instruction": "i", "input": "", "output": "o"}': ("instruction", [("user", "i"), ("assistant", "o")]),
    '{"id": 5, "instruction": "i", "input": "n", "output": "o", "source": "x"}': ("instruction", [("user", "i\nn"), ("assistant", "o")]),
    '{"id": 6, "messages": [{"role": "system", "content": "s"}, {"role": "user", "content": null}, {"role": "assistant", "content": "a"}]}': ("messages", [("system", "s"), ("user", ""), ("assistant", "a")]),
    '{"id": 7, "conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}, {"from": "tool", "value": "t"}]}': ("shared", [("user", "h"), ("assistant", "g"), ("tool", "t")]),
    '{"id": 8, "context": "c", "question": "q", "answer": "a"}': ("question", [("user", "c\nq"), ("assistant", "a")]),
    '{"id": 9, "unknown": {"a": [1]}}': (None, []),
    '{"id": 10, "prompt": "p"}': (None, []),
    '{"id": 11, "messages": []}': (None, []),
    "no json": (None, []),
}


def test_fingerprints_choose_layouts(spark):
    layouts = [x for x in LAYOUTS if x.name not in ("rows", "parts")]
    lines = spark.createDataFrame([(k,) for k in RECORDS], "line string")
    got = {r.line: (r.layout, [(t.role, t.text) for t in r.turns]) for r in chat_turns(parsed(lines.withColumn("copy", F.col("line")), "copy"), tuple(layouts)).collect()}
    assert got == RECORDS
    assert len({p for x in LAYOUTS for p in x.fingerprints}) == sum(len(x.fingerprints) for x in LAYOUTS)


def test_nested_parts_and_a_layout_of_ones_own(spark):
    df = spark.createDataFrame([([("user", [("a",), ("b",)]), ("assistant", [("c",)])],)], "messages array<struct<role: string, content: array<struct<text: string>>>>")
    assert field_paths(df.schema) == ["messages[].role", "messages[].content[].text"]
    (r,) = chat_turns(df).collect()
    assert r.layout == "parts" and [(t.role, t.text) for t in r.turns] == [("user", "ab"), ("assistant", "c")]
    own = Layout("deep", turns=(("user", ("ask.text",)), ("assistant", ("reply.best.text",))))
    deep = parsed(spark.createDataFrame([(json.dumps({"ask": {"text": "q"}, "reply": {"best": {"text": "a"}}}),)], "x string"), "x")
    (r,) = conversations_of(deep.withColumn("conv_id", F.lit(5)), layouts=(own,)).collect()
    assert r.formatted == "<turn>user\nq</turn><turn>assistant\na</turn>" and r.formatted[slice(*r.loss[0])] == "a"


def _units(text, kind):
    if kind is LINES:
        return re.findall(r"[^\n]*\n|[^\n]+", text)
    return list(text) if kind is CHARS else re.findall(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+", text)


@pytest.mark.parametrize("kind", [LINES, WORDS, CHARS], ids=["lines", "words", "chars"])
def test_cuts_are_those_of_a_list_of_units(kind):
    rng = random.Random(2)
    for text in ["", "\n", "a", "\n\n\na", "a\n\n", *("".join(rng.choices("a é\n😀\t", k=rng.randint(1, 40))) for _ in range(300))]:
        units, found = _units(text, kind), runs(text, kind)
        assert found.n == len(units)
        assert [found.cut(u) for u in range(len(units) + 1)] == [len("".join(units[:u])) for u in range(len(units) + 1)]


def test_fill_middle_is_brute_force_and_goes_back(spark):
    rng = random.Random(4)
    texts = [None, "", "\n", "a", "<P>", "x<M>y\n", "<", "<S\n>P", "\n" * 5000, "long line " * 20_000, *("".join(rng.choices("a<>PSM é\n", k=rng.randint(0, 60))) for _ in range(200))]
    rows = [(None if i == 3 else i % 180, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, output string, form int")
    want = []
    for i, t in rows:
        t, h = t or "", hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
        h1, h2, _, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
        u = _units(t, LINES)
        a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
        p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
        if not t or any(x in t for x in ("<P>", "<S>", "<M>")):
            want.append((i, len(u), "plain", None, None, t, t))
        elif h4 % 100 < 50:
            want.append((i, len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", t))
        else:
            want.append((i, len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", t))
    got = [tuple(r) for r in rebuilt(fill_middle(df)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert all(restored(r[5], r[2]) == r[6] for r in got)
    assert fill_middle(df.limit(0)).collect() == []


def test_plans_of_ones_own(spark):
    df = spark.createDataFrame([(i, "one two three\nfour") for i in range(40)], "doc_id long, text string")
    plan = Plan(seed=1, units=WORDS, prefix="[pre]", suffix="[suf]", middle="[mid]", rate=50, suffix_first=0)
    got = rebuilt(fill_middle(df, plan), plan).collect()
    assert {r.form for r in got} == {"plain", "psm"} and {r.restored for r in got} == {"one two three\nfour"} and {r.n for r in got} == {4}
    for bad in ({"prefix": "<S>"}, {"middle": ""}, {"prefix": "<<"}):
        with pytest.raises(ValueError):
            Plan(**bad)
