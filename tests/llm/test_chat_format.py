import json
import random
from decimal import Decimal

from pyspark.sql import functions as F

from siftwire.llm import chat_format as chat

RULES = [("get", "city", "string", True, None), ("get", "days", "integer", False, None), ("get", "unit", "string", False, ["c", "f"])]


def linked(spark, calls, results):
    rows = [(c, t, n, i, tool, args, needs) for c, t, n, i, tool, args, needs in calls]
    out = chat.link(spark.createDataFrame(rows, chat.CALL).repartition(3), spark.createDataFrame(results, chat.RESULT), chat.schema_rows(spark, RULES))
    return out.orderBy("conv_id", "place").collect()


def test_links_validates_and_writes_canonical_json(spark):
    calls = [
        (1, 0, 0, "a", "get", '{"unit": "c",  "city": "X\\u00e9", "days": 2}', []),
        (1, 0, 1, "b", "get", '{"days": "2", "unit": "k", "more": 1}', ["a"]),
        (1, 2, 0, "a", "get", "{}", []),
        (1, 3, 0, "c", "nothing", "{}", None),
        (1, 4, 0, "d", "get", "[1]", None),
        (1, 5, 0, None, "get", None, None),
        (None, 0, 0, "a", "get", '{"city": "x"}', []),
    ]
    results = [(1, 1, "a", "first"), (1, 2, "a", "second"), (1, 1, "zz", "lost"), (1, 3, "b", None)]
    got = linked(spark, calls, results)
    by = {(r["conv_id"], r["turn"], r["call_id"], r["status"]): r for r in got}
    first = by[(1, 0, "a", "linked")]
    assert first["errors"] == [] and first["json"] == '{"arguments":{"city":"Xé","days":2,"unit":"c"},"id":"a","result":"first","status":"linked","tool":"get"}'
    assert by[(1, 0, "b", "linked")]["errors"] == ["choice unit", "missing city", "type days", "unknown more"]
    assert by[(1, 3, "c", "open")]["errors"] == ["no such tool"] and by[(1, 4, "d", "open")]["errors"] == ["not an object"]
    assert {k[3] for k in by} == {"linked", "open", "duplicate", "unnamed", "orphan"} and len(got) == 8
    assert all(list(json.loads(r["json"])) == sorted(json.loads(r["json"])) for r in got)
    assert [r["place"] for r in got if r["conv_id"] == 1] == list(range(1, 8))


def test_order_is_topological(spark):
    needs = {"a": ["e"], "b": ["a"], "c": [], "d": ["b", "zz"], "e": ["c"], "f": ["f"], "g": ["f"]}
    calls = [(7, i, 0, k, "get", '{"city":"x"}', v) for i, (k, v) in enumerate(needs.items())]
    calls += [(8, i, 0, f"n{i}", "get", '{"city":"x"}', [f"n{i - 1}"]) for i in range(300)]
    got = linked(spark, calls, [])
    place = {r["call_id"]: r["place"] for r in got}
    assert all(place[n] < place[k] for k, v in needs.items() for n in v if n in place and k not in "fg")
    assert {r["call_id"] for r in got if r["status"] == "cyclic"} == {"f", "g"}
    assert [place[f"n{i}"] for i in range(300)] == list(range(1, 301))


def test_plain_turns(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "r"), (1, 3, "user", None), (2, 0, "assistant", "lone"), (3, 0, None, "x")]
    calls, results = chat.exchanges(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    got = chat.link(calls, results, chat.schema_rows(spark, chat.REPLY_SCHEMA)).orderBy("conv_id", "place").collect()
    assert [(r["call_id"], r["status"]) for r in got] == [("1-0", "open"), ("1-1", "linked"), ("1-3", "open"), ("2--1", "orphan"), ("3-0", "open")]
    assert [r["errors"] for r in got] == [[], [], [], [], ["missing role"]]


def test_empty(spark):
    assert linked(spark, [], []) == []


def test_types_are_those_of_the_json_values(spark):
    kinds = ["string", "integer", "number", "boolean", "null", "array", "object", None]
    values = {
        '"x"': {"string"}, '"2"': {"string"}, '"true"': {"string"}, '"[x"': {"string"}, '"{}"': {"string"}, '"null"': {"string"}, '""': {"string"},
        "5": {"integer", "number"}, "-7": {"integer", "number"}, "123456789012345678901234567890": {"integer", "number"}, "2.5": {"number"}, "2.0": {"number"}, "1e3": {"number"},
        "true": {"boolean"}, "false": {"boolean"}, "null": {"null"}, "[]": {"array"}, "[1]": {"array"}, "{}": {"object"}, '{"a":[1]}': {"object"},
    }
    rules = chat.schema_rows(spark, [("set", f"a-{k}", k, True, None) for k in kinds])
    calls = [(i, "set", "{" + ", ".join(f'"a-{k}": {v}' for k in kinds) + "}") for i, v in enumerate(values)]
    got = {r["id"]: r["errors"] for r in chat.validated(spark.createDataFrame(calls, "id int, tool string, arguments string"), rules).collect()}
    for i, (value, right) in enumerate(values.items()):
        assert got[i] == sorted(f"type a-{k}" for k in kinds if k not in right | {None}), value
    first = linked(spark, [(1, 0, 0, "b", "get", '{"days": "2", "unit": "k", "more": 1}', None)], [])[0]
    assert first["errors"] == ["choice unit", "missing city", "type days", "unknown more"]


def canonical(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", chat.canonical_json(F.col("t")).alias("c")).collect()
    return [c for _, c in sorted(map(tuple, rows))]


def test_one_text_for_each_number(spark):
    same = {
        "1": ["1", "1.0", "1e0", "10e-1", "0.1e1", "1.000E+00", "100e-2"], "100": ["100", "1e2", "100.0", "1E+2"], "0": ["0", "-0", "0.0", "0e9", "-0.00e-5"],
        "-2.5": ["-2.5", "-25e-1", "-2.50", "-0.25e1"], "0.001": ["0.001", "1e-3", "10E-4"], "1.5e40": ["15e39", "1.5E40", "15" + "0" * 39], "1e-30": ["1e-30", "0." + "0" * 29 + "1"],
        "123456789012345678901234567890123456789012": ["123456789012345678901234567890123456789012", "1234567890123456789012345678901234567890.12e2"],
        "0.12345678901234567890123456789012345678901234567": ["0.12345678901234567890123456789012345678901234567"], "1e999999999": ["1e999999999", "0.1e1000000000"],
    }
    texts = [(t, want) for want, ts in same.items() for t in ts]
    got = canonical(spark, [f'{{"a": [{t} , "{t}"]}}' for t, _ in texts])
    assert got == [f'{{"a":[{want},"{t}"]}}' for t, want in texts]


def test_canonical_values_are_those_of_a_plain_reader(spark):
    rng = random.Random(5)

    def value(depth=0):
        kind = rng.randrange(7 if depth < 3 else 5)
        if kind < 2:
            return rng.choice(["1e3", "-0.50", "7", "12345678901234567890123", "3.14159", "0", "2E-7", "5.0"])
        if kind < 4:
            return json.dumps("".join(rng.choices(['"', "\\", "n1", "s", "é", "😀", "\n", "/", "{", ",", ":", " ", "12", "\u0001"], k=rng.randrange(6))), ensure_ascii=rng.random() < 0.5)
        if kind == 4:
            return rng.choice(["true", "false", "null"])
        inner = [value(depth + 1) for _ in range(rng.randrange(4))]
        return "[ " + " , ".join(inner) + "]" if kind == 5 else "{" + ", ".join(f'"{k}n1\\"{i}" :{v}' for i, (k, v) in enumerate(zip(rng.sample("zyxsn", len(inner)), inner, strict=True))) + " }"

    texts = [value() for _ in range(300)]
    read = lambda t: json.loads(t, parse_float=Decimal, parse_int=Decimal)
    for text, got in zip(texts, canonical(spark, texts), strict=True):
        assert read(got) == read(text), text
        assert json.dumps(json.loads(got), sort_keys=True, separators=(",", ":")).count(" ") == got.count(" ")
    assert canonical(spark, canonical(spark, texts)) == canonical(spark, texts)


def test_what_is_no_json_stays_none(spark):
    assert canonical(spark, [None, "", "{", "01", "1.", "+1", "-", '"a', '{"a":1 2}', "[1,]", "nope"]) == [None] * 11


def test_very_long_texts_and_extra_columns(spark):
    long = '{"city": "' + 'x\\"1 ' * 200_000 + '", "days": [' + "1.0, " * 100_000 + "2]}"
    more = {c: F.lit("mine") for c in ("json", "place", "status", "answer", "wave", "cyclic", "content", "at", "rules", "first", "turn_", "errors", "block")}
    calls = spark.createDataFrame([(1, 0, 0, "a", "get", long, [])], chat.CALL).withColumns(more)
    results = spark.createDataFrame([], chat.RESULT).withColumns({c: v for c, v in more.items() if c != "content"})
    (row,) = chat.link(calls, results, chat.schema_rows(spark, RULES).withColumns(more)).collect()
    assert json.loads(row["json"])["arguments"] == json.loads(long)
    assert row["json"].startswith('{"arguments":{"city":"x\\"1 x') and '"days":[1,1,1,' in row["json"]


def plain_order(calls):
    """Order keys and cycles by their definition: the longest way over backward needs."""
    first = {}
    for c, t, n, i, *_ in sorted(calls, key=lambda r: r[:3]):
        first.setdefault((c, i), (t, n))
    needs = {(c, i): [(c, x) for x in needed if (c, x) in first] for c, t, n, i, _, _, needed in calls if first[(c, i)] == (t, n)}
    wave, many = dict.fromkeys(needs, 0), len(needs) + 1
    for _ in range(many):
        wave = {k: max([wave[x] + (first[x] >= first[k]) for x in v], default=0) for k, v in needs.items()}
    grown = wave
    for _ in range(many):
        grown = {k: max([grown[x] + (first[x] >= first[k]) for x in v], default=0) for k, v in needs.items()}
    return first, wave, {k for k in wave if grown[k] > wave[k]}


def test_links_and_order_against_a_plain_version(spark):
    rng = random.Random(9)
    calls, results = [], []
    for conv in range(40):
        ids = [f"c{i}" for i in range(rng.randrange(1, 12))]
        for turn, i in enumerate(rng.sample(ids, len(ids)) + rng.choices(ids, k=2)):
            calls.append((conv, turn, rng.randrange(3), i, "get", '{"city":"x"}', rng.choices(ids, k=rng.choice([0, 0, 0, 1, 2])) + ["gone"] * rng.randrange(2)))
        results += [(conv, rng.randrange(9), rng.choice([*ids, "lost"]), f"r{k}") for k in range(8)]
    first, wave, cyclic = plain_order(calls)
    answers = {}
    for conv, turn, i, content in sorted(results, key=lambda r: (r[0], r[1], r[3])):
        answers.setdefault((conv, i), content)
    got = linked(spark, calls, results)
    by_conv = {}
    for r in got:
        by_conv.setdefault(r["conv_id"], []).append(r)
        key = (r["conv_id"], r["call_id"])
        if r["status"] in ("linked", "open", "cyclic"):
            assert (r["status"] == "cyclic") == (key in cyclic)
            assert json.loads(r["json"]).get("result") == answers.get(key)
    assert {(r["conv_id"], r["call_id"]) for r in got if r["status"] in ("linked", "open", "cyclic")} == set(first)
    assert sum(r["status"] == "orphan" for r in got) == sum((c, i) not in first for c, _, i, _ in results)
    assert sum(r["status"] == "duplicate" for r in got) == len(calls) - len(first)
    for conv, rows in by_conv.items():
        assert [r["place"] for r in rows] == list(range(1, len(rows) + 1))
        own = [(conv, r["call_id"]) for r in rows if r["status"] in ("linked", "open")]
        assert own == sorted(own, key=lambda k: (wave[k], *first[k]))
