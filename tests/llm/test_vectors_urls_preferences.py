import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from gapline.llm import components, inner_product, neardup_vectors, url_filter
from gapline.llm.preferences import preferences
from gapline.llm.shared import ship

SCHEMA = "vec_id long, embedding array<float>, label int, score double, node string"


@pytest.fixture(scope="module")
def vectors(spark):
    """Random vectors, families at all distances around the threshold, copies, a hot label, and rows that take no part."""
    draw = np.random.default_rng(5)
    rows, n = [], 0
    for f in range(40):
        base = draw.normal(size=16)
        for k in range(draw.integers(1, 12)):
            x = base + draw.normal(size=16) * draw.choice([0, 0.05, 0.2, 0.3, 0.4])
            rows.append((n, [float(np.float32(v)) for v in x], int(f % 3), 0.0, "x"))
            n += 1
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [float("inf")] + [1.0] * 15]
    rows += [(n + i, x, 0, None, None) for i, x in enumerate(odd)]
    rows += [(n + 10, rows[0][1], None, None, None), (n + 11, rows[0][1], 0, None, None), (n + 11, rows[0][1], 0, None, None), (n + 12, [1.0] * 3, 0, None, None)]
    rows += [(n + 13, [1.0, 2.0, 3.0], 0, None, None), (n + 14, [1.0, 2.0, 3.1], 0, None, None), (n + 15, [2.0], 0, None, None), (n + 16, [0.5], 0, None, None)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def usable(x):
    return bool(x) and all(v is not None and np.isfinite(v) for v in x) and any(x)


def test_near_duplicates_are_brute_force(spark, vectors):
    rows, df = vectors
    take = [i for i, r in enumerate(rows) if usable(r[1]) and r[2] is not None]
    links, root = {i: 0 for i in range(len(rows))}, list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in take:
        for j in take:
            if j < i and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                x, y = np.array(rows[i][1]), np.array(rows[j][1])
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                    links[i] += 1
                    links[j] += 1
                    a, b = find(i), find(j)
                    root[a] = b
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    wanted = sorted((r[0], links[i], least[find(i)]) for i, r in enumerate(rows))
    for chunk, widths in ((4096, 32), (7, 1)):  # with one fitted length the others are compared exactly
        got = neardup_vectors.link(df, parts=4, chunk=chunk, max_widths=widths).collect()
        assert sorted((r["id"], r["n_links"], r["component_id"]) for r in got) == wanted
    assert sum(links.values()) > 50


@pytest.mark.parametrize("widths", [32, 1])
def test_search_is_brute_force(vectors, widths):
    rows, df = vectors
    take = [(r[0], np.array(r[1])) for r in rows if usable(r[1])]
    asks = lambda i, x: i % 10 == 0 or len(x) == 3
    found = inner_product.search(df, (F.col("vec_id") % 10 == 0) | (F.size("embedding") == 3), k=5, max_rows=200, max_widths=widths, chunk=64, query_chunk=8).toPandas()
    queries = [(i, x, row) for row, (i, x) in enumerate(take) if asks(i, x)]
    assert len({i for i, _, _ in queries}) == len(queries)
    assert set(found["query_id"]) == {i for i, x, row in queries if sum(len(y) == len(x) for _, y in take) > 1}
    hits = wanted = 0
    for i, x, row in queries:
        of = found[found["query_id"] == i].sort_values("rank")
        exact = sorted((-(y @ x), j) for k, (j, y) in enumerate(take) if k != row and len(y) == len(x))[:5]
        assert list(of["rank"]) == list(range(1, len(exact) + 1))
        got = list(zip(-of["score"], of["vec_id"]))
        assert got == sorted(got)
        for s, j in got:
            assert any(j == v and -s == pytest.approx(y @ x) for v, y in take if len(y) == len(x))
        hits += len({j for _, j in exact} & set(of["vec_id"]))
        wanted += len({j for _, j in exact})
    assert hits / wanted >= 0.9


def test_rows_that_share_an_id_are_queries_of_their_own(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 1.0]), (None, [0.5, 3.0])], "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r["vec_id"] if r["vec_id"] is not None else -1, r["score"]) for r in inner_product.search(df, F.col("vec_id") == 0).collect())
    # each is a candidate of the other
    assert got == [(1, -1, 3.0), (1, 1, 2.0), (2, -1, 0.5), (2, 1, 1.0), (3, 0, 0.0), (3, 0, 0.0)]


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_scans_find_the_best_rows(spread):
    """On one large chunk, also with very different norms; a scan of random numbers finds few."""
    draw = np.random.default_rng(8)
    x = draw.normal(size=(16384, 64)) * np.exp(spread * draw.normal(size=(16384, 1)))
    codes = inner_product.Codes.load(inner_product.Codes.fit(x[:4000], 2, 63 * 0.04 / 0.96).dump())
    columns = np.ascontiguousarray(codes.pack(x).T)
    of = np.arange(0, 1000, 25)
    recall = {}
    for scan in ("tables", "random"):
        if scan == "random":
            codes.scan = lambda query, columns: draw.integers(0, 1 << 20, columns.shape[1]).astype(np.uint32)
        a, b, _ = inner_product.best(codes, of, x[of], np.arange(len(x)), np.arange(len(x)), x, columns, 20, 400)
        hits = 0
        for i, q in enumerate(of):
            exact = x @ x[q]
            exact[q] = -np.inf
            hits += len(set(np.argsort(-exact)[:20]) & set(b[a == i]))
        recall[scan] = hits / (20 * len(of))
    assert recall["tables"] >= 0.95 and recall["random"] < 0.2


def test_few_and_no_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 1.0]), (2, None)], "vec_id long, embedding array<double>")
    got = inner_product.search(df, F.col("vec_id") == 0, k=20).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 1, 5.0)]
    empty = df.limit(0)
    assert inner_product.search(empty, F.lit(True)).count() == 0
    assert neardup_vectors.link(empty.withColumn("label", F.lit(1))).count() == 0


def test_anisotropic_codes_weigh_the_parallel_error():
    x = np.random.default_rng(0).normal(size=(600, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)

    def parallel(eta):
        codes = inner_product.Codes.fit(x.copy(), 2, eta)
        c = codes.assign(x)
        rebuilt = np.concatenate([codes.books[p][c[:, p]] for p in range(c.shape[1])], 1)
        return (((x - rebuilt) * x).sum(1) ** 2).mean()

    assert parallel(6.0) < 0.8 * parallel(1.0)


def test_visits_reach_one_end_of_every_link():
    draw = np.random.default_rng(3)
    x = draw.normal(size=(400, 8))
    x = np.concatenate([x, x + draw.normal(size=x.shape) * 0.15])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = neardup_vectors.Index.load(neardup_vectors.Index.fit(x, 12, 4).dump())
    own, codes, error = index.code(x)
    reach = np.sqrt(2 - 2 * 0.93)
    goes = index.visits(x, own, reach)
    for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.93, 1))):
        assert own[i] == own[j] or goes[i, own[j]] or goes[j, own[i]]
        looked_up = index.tables(x[i : i + 1], own[j])[0][np.arange(4), codes[j]].sum()
        assert np.sqrt(max(looked_up, 0)) <= reach + error[j] + 1e-3


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 50)] + [(1000 + i, 1000) for i in range(30)] + [(7, 7), (2000, 3000), (3000, 2000)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{1000 + i: 1000 for i in range(30)}, 2000: 2000, 3000: 2000}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


RULES = {"net/": "block", "example.net/en/": "allow", "org/fr/": "allow", "b.org/fr": "block"}
URLS = [
    None, "", "no scheme", "http://net/", "http://net", "https://x.NET/a?q#f", "http://sub.example.net/en/1", "http://notexample.net/en/1",
    "http://example.net/EN/", "x://b.org/fr", "x://a.b.org/frog", "x://org/fr/y", "http://org?x=http://net/", "http://a.net#/en", "http://" + "a." * 9000 + "net/" + "p" * 50000,
    "http://é.net/ü", "http://net:80/",
]


def judged(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    best = None
    for rule in RULES:
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or (-len(rule), rule) < (-len(best), best)):
            best = rule
    return host, path, best, RULES.get(best, "allow")


def test_urls_are_judged_as_rules_say(spark):
    df = spark.createDataFrame([(i, u, "old", "old") for i, u in enumerate(URLS)], "page_id long, url string, host string, verdict string")
    got = url_filter.filter_urls(df, RULES).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in got] == [judged(u) for u in URLS]
    assert url_filter.filter_urls(df.limit(0), RULES).count() == 0
    assert {r["verdict"] for r in url_filter.filter_urls(df, {}).collect()} == {"allow"}
    rules = spark.createDataFrame(list(RULES.items()), "rule string, verdict string")
    joined = url_filter.filter_urls_by_join(df.select("page_id", "url"), rules).orderBy("page_id").collect()
    assert [(r["rule"], r["verdict"]) for r in joined] == [judged(u)[2:] for u in URLS]
    nobody = url_filter.filter_urls_by_join(df.withColumn("page_id", F.lit(None).cast("long")), rules)  # no key is needed
    assert sorted(r["rule"] or "" for r in nobody.collect()) == sorted(r["rule"] or "" for r in joined)
    assert {r["verdict"] for r in url_filter.filter_urls_by_join(df, rules.limit(0)).collect()} == {"allow"}


def test_digest_collisions_are_confirmed_by_strings(tmp_path):
    same = lambda b: xxhash.xxh64_intdigest(b) % 2  # noqa: E731  two digests for all strings
    rules = {f"h{i}.org/": "block" for i in range(20)}
    (tmp_path / "f").write_bytes(url_filter.build(rules, same))
    array = url_filter.DigestArray(str(tmp_path / "f"), same)
    keys = [k.encode() for k in [*rules, "h99.org/", ""]]
    places = array.find(keys)
    assert [array.text(p) for p in places[:20]] == keys[:20] and list(places[20:]) == [-1, -1]
    assert list(array.judge(["a.h3.org", "h33.org"], ["/x", "/x"])) == [places[3], -1]


def test_files_over_their_bound_are_refused(spark):
    with pytest.raises(ValueError, match="bound"):
        ship(spark, b"x" * 100, "big", 10)


TURNS = [
    (1, "chosen", 0, "system", "s"), (1, "chosen", 1, "user", "q"), (1, "chosen", 2, "assistant", "yes"), (1, "chosen", 3, "user", "and?"), (1, "chosen", 4, "assistant", "more"),
    (1, "rejected", 1, "user", "q"), (1, "rejected", 0, "system", "s"), (1, "rejected", 2, "assistant", "no"),
    (2, "chosen", 0, "user", "a"), (2, "rejected", 0, "assistant", "a"),
    (3, "chosen", 0, "user", "same"), (3, "rejected", 0, "user", "same"),
    (4, "chosen", 0, "user", "alone"), (None, "chosen", 0, "user", "x"), (None, "rejected", 0, "user", "x"), (5, None, 0, "user", "x"),
    (6, "chosen", None, None, None), (6, "chosen", 0, "user", ""), (6, "chosen", 0, "user", ""), (6, "rejected", None, "user", ""), (6, "rejected", 1, "assistant", "z" * 100000),
]


def show(role, text):
    return f"<|{role}|>\n{text}<|end|>\n"


def test_preferences(spark):
    df = spark.createDataFrame([(*t, "x") for t in TURNS], "pair long, side string, turn long, role string, text string, prompt string")
    got = {r["pair"]: r for r in preferences(df, "pair", "side").collect()}
    assert set(got) == {1, 2, 3, 6}
    a = got[1]
    assert (a["n_common"], a["prompt"]) == (2, show("system", "s") + show("user", "q"))
    assert a["chosen"] == show("assistant", "yes") + show("user", "and?") + show("assistant", "more") and a["rejected"] == show("assistant", "no")
    assert [a["chosen"][s:e] for s, e in a["chosen_spans"]] == ["yes<|end|>\n", "more<|end|>\n"] and [a["rejected"][s:e] for s, e in a["rejected_spans"]] == ["no<|end|>\n"]
    assert (got[2]["n_common"], got[2]["prompt"], got[2]["chosen_spans"]) == (0, "", [])
    assert (got[3]["n_common"], got[3]["chosen"], got[3]["rejected"]) == (1, "", "")
    assert got[6]["n_common"] == 1 and got[6]["chosen"] == show("user", "") * 2
    assert preferences(df.limit(0), "pair", "side").count() == 0


def test_result_types(spark, vectors):
    got = neardup_vectors.link(vectors[1], parts=4).toPandas()
    assert isinstance(got, pd.DataFrame) and list(got.columns) == ["id", "n_links", "component_id"]
