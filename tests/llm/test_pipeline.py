import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gapline.llm.shared import written
from tests.llm.test_text_operators import fill, tokens

DOCS, LABELS = "doc_id long, text string, lang string, source string", "doc_id long, toxic int"


def planted():
    """Two languages with words of their own, toxic rows, groups of near and exact copies, junk; all ids differ."""
    draw, rows, labels = np.random.default_rng(5), [], []
    word = {k: ["".join(draw.choice(list(letters), 6)) for _ in range(400)] for k, letters in (("aa", "abcdefg"), ("bb", "opqrstu"))}
    for i in range(600):
        lang = ("aa", "bb")[i % 2]
        w = [str(x) for x in draw.choice(word[lang], 60)]
        if i % 5 == 0:
            w[10:10] = ["gabefac", "ruqsotp"]
        rows.append((i, " ".join(w), lang, ("s", "t", None)[i % 3]))
        labels.append((i, int(i % 5 == 0)))
    groups = {}
    for g in range(20):
        of = rows[5 * g + 1]
        w = of[1].split()
        near = [" ".join(w), " ".join(w[:-1]), " ".join([*w, "abcabc"])]
        groups[of[0]] = {of[0], *range(1000 + 3 * g, 1003 + 3 * g)}
        rows += [(1000 + 3 * g + k, t, of[2], "s") for k, t in enumerate(near)]
    junk = [(2000, None, "aa", "s"), (2001, "", "bb", "s"), (2002, "12 34 !!", "aa", "t"), (2003, " \n\t", None, None)]
    return rows + junk, labels, groups


def saved(spark, folder, rows, labels):
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (tokens(a), tokens(b)))
    return len(x & y) / len(x | y)


def test_every_stage_and_the_run_on_planted_rows(spark, tmp_path):
    rows, labels, groups = planted()
    folder = saved(spark, tmp_path, rows, labels)
    text, toxic = {r[0]: r[1] for r in rows}, {i for i, t in labels if t}
    docs, after = spark.read.parquet(f"{folder}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs, _ = written(stage(spark, docs, folder))
        after.append(docs.toPandas())
    known, clean, single, mixed, packed = after
    for kept in (known, clean, single, mixed):
        assert list(kept.columns) == ["doc_id", "text", "lang", "source"]
    lettered = {i for i, t in text.items() if re.search("[a-z]", t or "")}
    assert set(known["doc_id"]) <= lettered and len(known) > 0.97 * len(lettered)
    assert set(clean["doc_id"]) == set(known["doc_id"]) - toxic
    # one of each group, and all that is near nothing
    for of in groups.values():
        held = of & set(clean["doc_id"])
        assert len(of & set(single["doc_id"])) == (1 if held else 0)
    grouped = set().union(*groups.values())
    assert set(single["doc_id"]) - grouped == set(clean["doc_id"]) - grouped
    assert max(jaccard(a, b) for a in single["text"][:60] for b in single["text"][-60:] if a != b) < 0.8
    sizes = single["text"].map(lambda t: len(tokens(t))).groupby(single["source"], dropna=False).sum()
    wanted = fill({None if s != s or s is None else s: int(n) for s, n in sizes.items()})
    words = int(mixed["text"].map(lambda t: len(tokens(t))).sum())
    assert words == pytest.approx(sum(wanted.values()), rel=0.05)
    assert packed["words"].sum() == words
    for _, of in packed.groupby("bin"):
        of = of.sort_values("slot")
        assert list(of["offset"]) == list(of["words"].cumsum() - of["words"]) and of["words"].sum() == of["used"].iloc[0] <= of["capacity"].iloc[0]
    ran = corpus_pipeline.run(spark, folder).agg(F.sum("words"), F.count("*")).first()
    assert tuple(ran) == (words, len(packed))


def test_the_run_on_empty_and_null_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, saved(spark, tmp_path / "empty", [], [])).count() == 0
    nulls = [(None, None, None, None), (1, None, "aa", "s"), (2, "", None, None)]
    assert corpus_pipeline.run(spark, saved(spark, tmp_path / "nulls", nulls, [(None, 1), (1, None)])).count() == 0


def test_stages_keep_columns_named_like_results(spark, tmp_path):
    rows, labels, _ = planted()
    folder = saved(spark, tmp_path, rows[:200], labels)
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({"score": F.lit(99.0), "lang_pred": F.lit("mine"), "Predicted": F.lit("mine")})
    for stage in (corpus_pipeline.identify_language, corpus_pipeline.reject_toxic):
        docs = stage(spark, docs, folder)
        got = docs.collect()
        assert docs.columns[-3:] == ["score", "lang_pred", "Predicted"] and got
        assert {(r["score"], r["lang_pred"], r["Predicted"]) for r in got} == {(99.0, "mine", "mine")}
