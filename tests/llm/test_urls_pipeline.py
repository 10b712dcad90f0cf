from __future__ import annotations

import re
import string

from cases import ROWS

from lathe.llm import urls
from lathe.llm.queries import op2_url_filters

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def parts(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    return host.translate(LOWER), re.split(r"[?#]", rest[len(host) :])[0]


def rule_of(host: str, path: str):
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith("/" + r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


def check(rows, pages) -> None:
    assert len(rows) == len(pages)
    for r in rows:
        host, path = parts(pages[r.page_id])
        rule = rule_of(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.name)
        assert r.verdict in ("allow", "block") and (not rule or r.verdict == ("allow" if rule.allow else "block"))


def test_url_query(spark, small):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    check(op2_url_filters(spark, small).collect(), pages)


def test_trees_agree_with_held_out_labels(spark):
    """Labelled urls that the trees did not learn from."""
    rows = urls.judge(spark.read.parquet("/root/testdata/sf0.1/pages.parquet")).where("held_out and rule is not null").collect()
    right = sum((r.score >= 0.5) == (r.verdict == "block") for r in rows)
    assert len(rows) > 100 and right > 0.85 * len(rows)


def test_suffix_statistics_are_learned(spark):
    """Hosts are told apart by their endings, whatever these are; of a sample too."""
    kinds = ["alpha", "beta", "gamma", "delta"]
    rows = [(f"https://h{i * 7919 % 997}.x{i % 13}.{kinds[i % 4]}/p/{i}", int(i % 4 in (1, 2))) for i in range(2000)]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    labelled = spark.createDataFrame(rows, "url string, y int")
    for sample in (100_000, 700):
        out = urls.judge(pages, (urls.Rule("nowhere", "", True),), labelled, sample=sample).collect()
        held = [r for r in out if r.held_out]
        assert 300 < len(held) < 500 and all((r.verdict == "block") == bool(rows[r.page_id][1]) for r in held)


def test_url_edges(spark):
    pages = {1: None, 2: "no scheme", 3: "HTTP://EXAMPLE.COM/en/7", 4: "a://b://c/d?x#y", 5: "x://", 6: "http://Com/en/", 7: "http://example.net/de/81", 8: "http://xcom/en/", 9: "http://h?/en", None: "http://a.org/es/é\nq", 10: ""}
    check(urls.judge(spark.createDataFrame(list(pages.items()), "page_id long, url string")).collect(), pages)
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, host string, rule string")).collect() == []


def test_trees_learn_labels(spark):
    rows = [(f"http://{'a' * (i % 30)}.example.com/x/{i}", int(i % 30 > 14)) for i in range(600)]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    out = urls.judge(pages, (urls.Rule("nowhere", "", True),), spark.createDataFrame(rows, "url string, y int")).collect()
    assert sum((r.verdict == "block") == bool(rows[r.page_id][1]) for r in out) > 0.97 * len(rows)


def test_pipeline_against_brute_force(spark, small):
    """Each stage by the operators' plain forms on lists."""
    import corpus_pipeline
    from lathe.llm import quality
    from lathe.llm.common import crc_mod
    from lathe.llm import toxicity
    from pyspark.sql import functions as F
    from test_texts import check_packed, like_groups
    from tokenizers import Tokenizer

    from lathe.llm.queries import tokenizer

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "toxicity", "near-duplicates", "substring dedup", "packing"]
    source = spark.read.parquet(f"{small}/documents.parquet")
    docs = {r.doc_id: r.text.encode() for r in source.collect()}
    judged = {d: quality.judged(t, quality.QualityRules()) for d, t in docs.items()}
    docs = {d: j[-1] for d, j in judged.items() if j[6]}
    staged = quality.keep_good(source)
    assert {r.doc_id: r.text.encode() for r in staged.collect()} == docs and staged.columns == source.columns
    model = toxicity.fit(staged.where(crc_mod(F.col("doc_id"), 3) != 1), spark.read.parquet(f"{small}/labels.parquet"))
    scorer = toxicity.Scorer(model)
    docs = {d: t for d, t in docs.items() if scorer.score(t.decode())[0] < 0.7}
    staged = toxicity.keep_clean(staged, model, threshold=0.7)
    assert texts_of(staged) == docs
    least = like_groups(docs)
    docs = {d: t for d, t in docs.items() if least[d] == d}
    staged = corpus_pipeline.near_duplicate_stage(spark, staged, small)
    assert texts_of(staged) == docs
    docs = without_repeats(docs, 20)
    staged = corpus_pipeline.substring_stage(spark, staged, small)
    assert texts_of(staged) == docs and staged.columns == source.columns
    assert all(r.n_chars == len(r.text) for r in staged.collect() if r.text.encode() != judged[r.doc_id][-1])
    with open(tokenizer("byte_bpe_50k.json"), "rb") as f:
        reference = Tokenizer.from_str(f.read().decode())
    ids = {d: [*e.ids, 1] for d, e in zip(docs, reference.encode_batch([t.decode() for t in docs.values()], add_special_tokens=False))}
    _, got = check_packed(corpus_pipeline.run(spark, small).collect(), ids, 2048)
    assert {d: sum(n for _, n in x) for d, x in got.items()} == {d: len(x) for d, x in ids.items()}


def texts_of(df) -> dict:
    return {r.doc_id: r.text.encode() for r in df.collect()}


def without_repeats(docs: dict, size: int) -> dict:
    """Each text less the words, with the white space after them, that an earlier window of size words has."""
    words = {d: re.findall(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", t) for d, t in sorted(docs.items())}
    seen, out = set(), {}
    for d, own in words.items():
        bare = [w.strip(b" \t\n\r\x0b\x0c") for w in own]
        gone = [False] * len(own)
        for i in range(len(own) - size + 1):
            window = tuple(bare[i : i + size])
            if window in seen:
                gone[i : i + size] = [True] * size
            seen.add(window)
        out[d] = b"".join(w for w, g in zip(own, gone) if not g) if any(gone) else docs[d]
    return out


def test_pipeline_learns_toxicity_from_all_labels(spark, tmp_path):
    """A toxic word that only labels beyond 30,000 of the table mark is known to the stage."""
    from pyspark.sql import functions as F

    import corpus_pipeline

    ids = [r.id for r in spark.range(33_000).orderBy(F.xxhash64("id"), "id").collect()]
    late = spark.createDataFrame([(i, 1) for i in ids[-300:]], "id long, late int")
    frame = spark.range(33_000).join(late, "id", "left").withColumn("toxic", F.coalesce("late", F.lit(0)))
    frame.select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    own = F.translate(F.col("id").cast("string"), "0123456789", "qwzxvkjyuh")  # no common words
    docs = frame.select(F.col("id").alias("doc_id"), F.when(F.col("toxic") > 0, F.concat(F.lit("you blorghet "), own)).otherwise(F.concat(F.lit("plain words "), own)).alias("text"))
    kept = corpus_pipeline.toxicity_stage(spark, docs, str(tmp_path))
    assert kept.count() == 32_700 and kept.where(F.col("text").contains("blorghet")).count() == 0
