"""Exact dedup, mixing and chat formatting: edge cases and brute force."""

import hashlib
import re

import pytest

exact_dedup = pytest.importorskip("traceloom.llm.exact_dedup")
from pyspark.sql import functions as F  # noqa: E402

from traceloom.llm import chat, mixing  # noqa: E402

DOCS = "doc_id bigint, text string, source string, keep_id string, size string"
ROWS = [
    (5, "a  b", "s1", "x", "x"),
    (2, "a b", "s1", "x", "x"),
    (9, "a\tb", None, "x", "x"),
    (3, None, "s2", "x", "x"),
    (4, "", "s2", "x", "x"),
    (7, " ", "s2", "x", "x"),
    (8, "word " * 5000, "s3", "x", "x"),
    (None, "a b", "s3", "x", "x"),
    (2, "a b", "s1", "x", "x"),
]


def test_exact_dedup(spark):
    found = exact_dedup.exact_duplicates(spark.createDataFrame(ROWS, DOCS)).collect()
    assert len(found) == len(ROWS)
    groups = {}
    for key, text, *_ in ROWS:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(key)
    for row in found:
        text = next(t for t, keys in groups.items() if hashlib.sha256(t.encode()).hexdigest() == row["text_sha256"])
        keep = min(k for k in groups[text] if k is not None)
        assert (row["keep_id"], row["group_size"]) == (keep, len(groups[text]))
        assert row["kept"] == (row["doc_id"] == keep)


def test_exact_dedup_empty(spark):
    assert exact_dedup.exact_duplicates(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize(("quotient", "block"), [(20, 8), (12, 3), (31, 8)])
def test_counting_quotient_filter_merges_losslessly(spark, quotient, block):
    import numpy as np

    values = [5, 5, -1, 7, 5, -1, 2**62, 2**62 + 1, -(2**63), 123456789012345678] * 3
    prints = spark.createDataFrame([(v,) for v in values], "p bigint").repartition(3)
    counts = {}
    for row in exact_dedup.merged_filter(prints, quotient, block).collect():
        counts |= dict(zip(*(x.tolist() for x in exact_dedup.unpack(row["block"], row["parts"], quotient, block))))
    kinds, times = np.unique(np.array(values, np.int64).view(np.uint64), return_counts=True)
    assert counts == dict(zip(kinds.tolist(), times.tolist()))


def test_exact_dedup_of_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT", 3)
    rows = [(i, ("a  b", "c", "d e", f"own {i}")[min(i % 7, 3)], "s", "x", "x") for i in range(200)] + [(0, "a b", "s", "x", "x")]
    given = spark.createDataFrame(rows, DOCS)
    found = exact_dedup.exact_duplicates(given).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    least = {}
    for key, text, *_ in rows:
        least[norm(text)] = min(key, least.get(norm(text), key))
    assert sorted((r["doc_id"], r["keep_id"]) for r in found) == sorted((key, least[norm(text)]) for key, text, *_ in rows)
    assert sorted(r["doc_id"] for r in exact_dedup.keep_first(given).collect()) == sorted(least.values())


def targets_by_hand(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, full, out = 1.5 * sum(sizes.values()), set(), {}
    while True:
        left = total - sum(2 * sizes[s] for s in full)
        share = sum(weights[s] for s in names if s not in full)
        out = {s: 2 * sizes[s] if s in full else left * weights[s] / share for s in names}
        over = {s for s in names if s not in full and out[s] > 2 * sizes[s]}
        if not over:
            return out
        full |= over


def test_mix_targets_and_copies(spark):
    rows = [(i, "w " * (i % 40 + 1), ["a", "b", None, "é", "z"][i * i % 5]) for i in range(600)] + [(1000, None, "empty"), (1001, "x " * 3000, "b")]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    expected, taken = targets_by_hand(sizes), {}
    for row in found:
        assert abs(row["target"] - expected[row["source"]]) < 1e-6 * max(1, expected[row["source"]])
        assert row["source_size"] == sizes[row["source"]] and 0 <= row["taken"] <= 2 * row["size"]
        taken[row["source"]] = taken.get(row["source"], 0) + row["taken"]
    for source, target in expected.items():
        assert abs(taken[source] - target) <= 2, (source, taken[source], target)
    again = mixing.mix(spark.createDataFrame(rows[::-1], "doc_id bigint, text string, source string")).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))


def dual_by_hand(rows, most=2.0):
    """Rates by plain coordinate search: for a shared multiplier, each source's own by bisection; that one by bisection."""
    import numpy as np

    size = np.array([n for n, _ in rows], float)
    source = np.array([s for _, s in rows])
    target = targets_by_hand({s: int(size[source == s].sum()) for s in set(source)})
    z = np.log(size)
    mean = (size * z).sum() / size.sum()
    z = (z - mean) / np.sqrt((size * (z - mean) ** 2).sum() / size.sum())

    def rates(mu):
        w = np.zeros(len(size))
        for s, t in target.items():
            own = source == s
            low, high = -60.0, 60.0
            for _ in range(200):
                mid = (low + high) / 2
                if (size[own] * np.minimum(np.exp(mid + mu * z[own]), most)).sum() < t:
                    low = mid
                else:
                    high = mid
            w[own] = np.minimum(np.exp(high + mu * z[own]), most)
        return w

    low, high = -5.0, 5.0
    for _ in range(100):
        mid = (low + high) / 2
        if (size * z * rates(mid)).sum() + mixing.PENALTY * size.sum() * mid < 0:
            low = mid
        else:
            high = mid
    return rates(high)


def test_mix_rates_solve_the_dual(spark):
    import random

    rng = random.Random(3)
    rows = [(rng.randrange(1, 400) if s != "c" else rng.randrange(200, 900), s) for s, n in (("a", 150), ("b", 400), ("c", 30), ("d", 500)) for _ in range(n)]
    given = spark.createDataFrame([(i, "w " * n, s) for i, (n, s) in enumerate(rows)], "doc_id bigint, text string, source string")
    found = {r["doc_id"]: r["rate"] for r in mixing.mix(given).collect()}
    expected = dual_by_hand(rows)
    assert max(abs(found[i] - w) for i, w in enumerate(expected)) < 1e-6
    assert len({round(w, 6) for w, (_, s) in zip(expected, rows) if s == "d"}) > 10


def test_mix_of_null_and_repeated_ids(spark):
    rows = [(None, f"w{i} " * (i % 9 + 1), "ab"[i % 2], "x") for i in range(60)] + [(7, f"v{i} " * 4, "a", "x") for i in range(20)] + [(8, "same text", "b", "x")] * 9
    found = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string, copies string")).collect()
    assert len(found) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in found)
    for source in "ab":
        own = [r for r in found if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 2


def test_mix_without_words(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    row = mixing.mix(spark.createDataFrame([(1, None, None)], "doc_id bigint, text string, source string")).first()
    assert (row["size"], row["target"], row["taken"]) == (0, 0.0, 0)


def test_mix_is_native(spark):
    plan = mixing.mix(spark.createDataFrame(ROWS, DOCS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


RECORDS = [
    ('{"messages":[{"role":"us\\ner\\\\n","content":"<\\\\|x <|"},{"role":"assistant","content":null}],"id":3}', [("us\ner\\n", "<\\|x <|"), ("assistant", "")]),
    ('{"conversations":[{"from":"human","value":"hi"},{"from":"gpt","value":"yo"}]}', [("user", "hi"), ("assistant", "yo")]),
    ('{"instruction":"a<|im_end|>","output":"b","meta":{"prompt":"q"}}', [("user", "a<|im_end|>"), ("assistant", "b")]),
    ('{"system":"s","prompt":"p","response":"r"}', [("system", "s"), ("user", "p"), ("assistant", "r")]),
    ('{"instruction":"a","output":"b","meta":{"a":{"b":{"x":"1"}},"prompt":"q"}}', [("user", "a"), ("assistant", "b")]),
    ('{"instruction":"a","output":"b","meta":{"a":{"b":{"c":{"d":1}}},"input":"q"}}', [("user", "a"), ("assistant", "b")]),
    ('{"turns":[{"role":"user","text":"q","meta":[{"role":"x"}]},{"role":"assistant","text":"a"}],"OBJECT<":{"prompt: ":1.5}}', [("user", "q"), ("assistant", "a")]),
    ('{"foo":1}', []),
    ('{"messages":[]}', []),
    ('{"messages":[{"role":"user","content":"q"},7]}', []),
    ("[1]", []),
    ("null", []),
    (None, []),
    ("{}", []),
]


@pytest.mark.parametrize("index", range(len(RECORDS)))
def test_chat_layouts_and_round_trip(spark, index):
    text, turns = RECORDS[index]
    record = spark.createDataFrame([(text,)], "j string").select(F.parse_json("j").alias("record"))
    row = chat.format_records(record, "record").select("turns", chat.parse(F.col("formatted")).alias("back")).first()
    assert [tuple(t) for t in row["turns"]] == turns == [tuple(t) for t in row["back"]]


def test_chat_paths_at_any_depth(spark):
    deep = '{"a":' * 30 + '{"role":"x"}' + "}" * 30
    texts = ['{"b":{"c":[[{"d":1,"e f":{}}],[]],"a`b":null},"b.c":2.5,"OBJECT":{"ARRAY":[]}}', deep, "{}", "3"]
    given = spark.createDataFrame([(t,) for t in texts], "j string").select(F.parse_json("j").alias("r"))
    found = [row[0] for row in given.select(chat.field_paths(F.col("r"))).collect()]
    assert found[0] == sorted(["b", "b.c", "b.c[][].d", "b.c[][].`e f`", "b.`a``b`", "`b.c`", "OBJECT", "OBJECT.ARRAY"])
    assert found[1] == sorted([".".join("a" * k) for k in range(1, 31)] + [".".join("a" * 30) + ".role"])
    assert found[2:] == [[], []]


def test_chat_layout_within_others_and_table_of_fingerprints(spark):
    layouts = (*chat.LAYOUTS, chat.Layout("inner", array="data.log.items", role="who", text="what"))
    texts = ['{"data":{"log":{"items":[{"who":"user","what":"q"},{"who":"tool","what":null}]}}}', '{"prompt":"p","response":"r"}', '{"prompt":"p","response":"r","id":1}', '{"id":1}']
    given = spark.createDataFrame([(t,) for t in [*texts, texts[1]]], "j string").select(F.parse_json("j").alias("r"), F.lit(1).alias("layout"))
    row = chat.format_records(given, "r", layouts).first()
    assert [tuple(t) for t in row["turns"]] == [("user", "q"), ("tool", "")]
    table = {tuple(row["paths"]): (row["layout"], row["n_records"]) for row in chat.fingerprint_table(given, "r", layouts).collect()}
    assert table[("prompt", "response")] == ("prompt_response", 2) and table[("id", "prompt", "response")] == ("prompt_response", 1)
    assert table[("id",)] == (None, 1) and len(table) == 4 and any(name == "inner" for name, _ in table.values())


def test_chat_is_native_and_empty_tables_stay_empty(spark):
    given = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    found = chat.digests(chat.format_records(chat.conversations_as_records(given), "record"))
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert found.count() == 0 and found.columns[:3] == ["conv_id", "n_turns", "turns_sha256"]


def test_chat_roles_are_reversible(spark):
    roles = ["a\nb", "a\\nb", "a\\\nb", "\x00", "\\\\n\n\\", "<|x", "n", "\\", "\n\n"]
    given = spark.createDataFrame([(r,) for r in roles], "r string")
    back = given.select("r", chat.unescape_role(chat.escape_role(F.col("r"))).alias("b"), chat.escape_role(F.col("r")).alias("e")).collect()
    assert all(row["r"] == row["b"] and "\n" not in row["e"] for row in back)


def test_chat_records_come_in_several_layouts(spark):
    rows = [(i, t, ("user", "assistant", "human")[min(t, 2)], f"text {i} {t}") for i in range(60) for t in range(2 + i % 2)]
    given = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    formatted = chat.format_records(chat.conversations_as_records(given), "record")
    assert formatted.select("fingerprint").distinct().count() >= 7
    for row in formatted.select("conv_id", chat.parse(F.col("formatted")).alias("back")).collect():
        assert [tuple(t) for t in row["back"]] == [(role, text) for i, _, role, text in rows if i == row["conv_id"]]


def test_chat_digests(spark):
    marks = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 1, "assistant", marks, "x"), (1, 0, "user", None, "x"), (1, 0, "user", "b" * 50_000, "x"), (None, None, None, None, "x"), (2, 0, "assistant", "é<\\|", "x")]
    given = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string")
    found = {r["conv_id"]: r for r in chat.digests(chat.format_records(chat.conversations_as_records(given), "record")).collect()}
    whole = f"user\n\nuser\n{'b' * 50_000}\nassistant\n{marks}\n"
    assert found[1]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest() and found[1]["n_turns"] == 3
    assert found[1]["loss_chars"] == len(marks) and found[1]["loss_sha256"] == hashlib.sha256(marks.encode()).hexdigest()
    assert found[2]["loss_sha256"] == hashlib.sha256("é<\\|".encode()).hexdigest()
    assert found[None]["n_turns"] == 1 and found[None]["loss_chars"] == 0
