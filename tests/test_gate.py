from pyspark.sql import functions as F

from siftwire.functions import text as T
from siftwire.operators import gate

ITEM = "seq long, source string, id string, title string, url string, body string"
PUB = "ord long, atomic_site_id string, domain_name string, status string, publisher_name string, aliases string"
PUBS = [
    (1, "7", "a.com", "active", "The Daily Bee", "Bee News|DB"),
    (2, "007", "b.a.com", "active", "C++ (News).x", " | "),
    (3, "30", "", "active", "Ñandú Times", "DB"),
    (4, "40", "gone.org", "churned", "Gone Herald", ""),
]
CASES = {
    ("github", "The Daily Bee", "http://a.com/", ""): ("bypass", None, None, None, "source github bypasses gate"),
    ("feed", "x", "https://WWW.a.com/p", ""): ("pass", "7", "domain", 1.0, "domain:a.com->a.com"),
    ("feed", "x", "http://b.a.com/", ""): ("pass", "7", "domain", 1.0, "domain:b.a.com->a.com"),
    ("feed", "about the daily bee", "", ""): ("pass", "7", "name", 1.0, "name:The Daily Bee"),
    ("feed", "x", "http://notaa.com/|x y", "more c++ (news).X!"): ("pass", "007", "name", 1.0, "name:C++ (News).x"),
    ("feed", "bee NEWS", "a.com/x", "db"): ("hold", None, None, None, "ambiguous: 2 candidates (7,30)"),
    ("feed", "ñANDÚ TIMES", "", ""): ("pass", "30", "name", 1.0, "name:Ñandú Times"),
    ("feed", "Bee Newsletter", "http://gone.org", "Gone Herald"): ("hold", None, None, None, "no deterministic signal"),
    ("feed", None, None, None): ("hold", None, None, None, "no deterministic signal"),
}


def decided(spark, cases, entities=None):
    rows = [(i, source, f"i{i}", title, url, body) for i, (source, title, url, body) in enumerate(cases)]
    df = gate.decide(spark.createDataFrame(rows, ITEM), spark.createDataFrame(PUBS, PUB), "v", entities)
    return [tuple(r)[2:7] for r in df.orderBy("seq").collect()]


def test_deterministic_stages(spark):
    assert decided(spark, CASES) == list(CASES.values())


def test_entities_and_bands(spark):
    orgs = [["Daily Bee"], ["acme widgets corporation"], [], ["Daily Beech"], ["DB", "bee news"], ["Nandu Time"]]
    entities = spark.createDataFrame(list(enumerate(orgs)), "seq long, orgs array<string>")
    got = decided(spark, [("feed", "x", "", "")] * len(orgs), entities)
    assert got[0] == ("pass", "7", "ner", 1.0, "ner:1")
    assert got[1][0] == "ignore" and got[1][4].startswith("ner: no client match (0.")
    assert got[2] == ("hold", None, None, None, "ner: no entities")
    assert got[3][0] == "pass" and 0.85 <= got[3][3] < 1
    assert got[4] == ("hold", None, None, 1.0, "ner: ambiguous (7,30)")
    assert got[5] == ("hold", None, None, 0.6957, "ner: low confidence (0.6957)")


def test_similarity_is_on_bytes_and_not_symmetric(spark):
    pairs = [("test", "wert"), ("wert", "test"), ("texas daily chronicle", "texas tribune"), ("", "a"), ("same", "same")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [round(r["s"], 4) for r in df.select(gate.similarity("a", "b").alias("s")).collect()]
    assert got == [0.25, 0.5, 0.5294, 0.0, 1.0]


def test_hosts_and_names(spark):
    hosts = {"http://www.x.org:80/a": "x.org", "//u:p@X.org/": "x.org", "abq.news/x": "", "https://a_b.example/|": "a_b.example", "": "", "http://www.www.a.com": "www.a.com"}
    names = {"  The   Bee!! ": "bee", "THE the bee": "the bee", "A.B-C": "a b c", "Ñ": "Ñ", "then": "then"}
    got = spark.createDataFrame([(k,) for k in hosts], "u string").select("u", T.host(F.col("u")).alias("h")).collect()
    assert {r["u"]: r["h"] for r in got} == hosts
    got = spark.createDataFrame([(k,) for k in names], "u string").select("u", T.normal_name(F.col("u")).alias("h")).collect()
    assert {r["u"]: r["h"] for r in got} == names


def test_letters_that_match_in_any_case(spark):
    pubs = spark.createDataFrame([(1, "1", "", "active", "Smith Press", "ΑΣ|Straẞe|Kelvin"), (2, "2", "", "active", "ISTANBUL İş", "")], PUB)
    titles = ["the \u017fmith pre\u017f\u017f.", "xx ας'Β", "straße", "\u212aelvin", "Istanbul İş", "smithpress"]
    rows = spark.createDataFrame([(i, "feed", f"i{i}", t, "", "") for i, t in enumerate(titles)], ITEM)
    assert sorted((r["seq"], r["ord"]) for r in gate.term_hits(rows, pubs).collect()) == [(0, 1), (1, 1), (2, 1), (3, 1), (4, 2)]


def test_term_hits_against_a_plain_loop(spark):
    import random
    import re

    rng = random.Random(3)
    words = ["ab", "Ab", "c", "C++", "d-e", "é", "É", "x.y", "7", "(ab)", "--", "_"]
    names = [" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(40)]
    pubs = spark.createDataFrame([(i, str(i), "", "active", n, names[-i]) for i, n in enumerate(names)], PUB)
    texts = [rng.choice([" ", ", "]).join(rng.choices(words, k=rng.choice([1, 5, 40]))) for _ in range(60)] + ["", None]
    rows = spark.createDataFrame([(i, "feed", "", t, "", "") for i, t in enumerate(texts)], ITEM)
    want = set()
    for i, t in enumerate(texts):
        for k, n in enumerate(names):
            if any(re.search(rf"(?<![^\W_]){re.escape(x)}(?![^\W_])", f"{t or ''} ", re.I) for x in (n, names[-k])):
                want.add((i, k))
    assert {(r["seq"], r["ord"]) for r in gate.term_hits(rows, pubs).collect()} == want


def test_the_extractor_only_gets_what_is_left(spark):
    asked = []

    def extractor(rows):
        asked.extend(r["seq"] for r in rows.collect())
        return rows.selectExpr("seq", "array('Daily Bee') as orgs")

    got = decided(spark, [("github", "", "", ""), ("feed", "x", "http://a.com/", ""), ("feed", "db", "", ""), ("feed", "nothing", "", "")], extractor)
    assert asked == [3] and got[3][0] == "pass" and got[3][2] == "ner"
    pubs = spark.createDataFrame(PUBS, PUB)
    assert gate.lookup(pubs, "007").first()["ord"] == 2 and gate.lookup(pubs, "8").count() == 0


def slow_similar_text(x, y):
    """The rule as it is written down, byte by byte."""
    best, at_x, at_y = 0, 0, 0
    for i in range(len(x)):
        for j in range(len(y)):
            k = 0
            while i + k < len(x) and j + k < len(y) and x[i + k] == y[j + k]:
                k += 1
            if k > best:
                best, at_x, at_y = k, i, j
    return best and best + slow_similar_text(x[:at_x], y[:at_y]) + slow_similar_text(x[at_x + best :], y[at_y + best :])


def random_names(n, seed):
    import random

    rng = random.Random(seed)
    words = ["daily", "news", "the", "times", "é", "ñandú", "post", "of", "a", "ab", "abc", "herald", "x" * 300]
    return ["".join(rng.choices("abcdeé", k=rng.randrange(1, 12))) if rng.random() < 0.5 else " ".join(rng.choices(words[: 12 + (i % 40 == 0)], k=rng.randrange(1, 4))) for i in range(n)]


def test_similar_text_and_best_names_against_all_pairs():
    orgs, names = random_names(40, 1), sorted(set(random_names(80, 2)))
    for a in orgs:
        for b in names[:20]:
            if len(a) + len(b) < 200:
                assert gate.similar_text(a.encode(), b.encode()) == slow_similar_text(a.encode(), b.encode()), (a, b)
    got = {}
    for org, name, s in gate.most_similar(orgs, names):
        got.setdefault(org, set()).add((name, s))
    for org in set(orgs):
        scores = {n: gate._similarity(org, n) for n in names}
        best = max(scores.values())
        assert got.get(org, set()) == {(n, s) for n, s in scores.items() if s == best > 0}, org


def test_best_publishers_in_small_blocks_equal_all_pairs(spark):
    names, orgs = random_names(60, 3), random_names(50, 4)
    pubs = spark.createDataFrame([(i, str(i), "", "active" if i % 7 else "churned", n, f"{names[-i]}|{names[i // 2]}") for i, n in enumerate(names)], PUB)
    entities = spark.createDataFrame([(i, [orgs[i], orgs[-i], " "] if i % 3 else []) for i in range(50)], "seq long, orgs array<string>")
    known = [(r["ord"], r["atomic_site_id"], n) for r, n in ((r, r["n"]) for r in gate.terms(pubs).select("ord", "atomic_site_id", T.normal_name(F.col("term")).alias("n")).collect())]
    normal = {r["o"]: r["n"] for r in spark.createDataFrame([(o,) for o in orgs], "o string").select("o", T.normal_name(F.col("o")).alias("n")).collect()}
    got = {r["seq"]: (r["best"], r["n"], r["ids"]) for r in gate.ner_best(entities, pubs, name_block=7, org_block=5).collect()}
    for i in range(50):
        scores = {}
        for org in [orgs[i], orgs[-i]] if i % 3 else []:
            for place, site, name in known:
                scores[place, site] = max(scores.get((place, site), 0.0), gate._similarity(normal[org], name))
        best = max(scores.values(), default=0.0)
        winners = [site for (_, site), s in sorted(scores.items()) if s == best > 0]
        assert got[i] == (best, len(winners), ",".join(winners)), i


def test_no_join_without_a_condition(spark):
    pubs = spark.createDataFrame(PUBS, PUB)
    plan = gate.ner_best(spark.createDataFrame([(1, ["Daily Bee"])], "seq long, orgs array<string>"), pubs)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_terms_beyond_the_broadcast_bound_give_the_same(spark):
    rows = [(i, "feed", f"i{i}", title, "", body) for i, (_, title, _, body) in enumerate(CASES)]
    items, pubs = spark.createDataFrame(rows, ITEM), spark.createDataFrame(PUBS, PUB)
    found = [sorted(map(tuple, gate.term_hits(items, pubs, bound).collect())) for bound in (1_000_000, 1)]
    assert found[0] == found[1] and found[0]
