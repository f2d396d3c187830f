import corpus_pipeline
from plainsight.llm import line_dedup, quality_rules
from plainsight.llm.common import read_labels
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages_do_their_work(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out, seen = docs, [docs]
    for _, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.save(stage(spark, out, SF), "test-stage")
        seen.append(out)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "mixing", "packing"]
    assert all(d.columns == docs.columns for d in seen[:-1])
    raw, good, lined, one, mixed, packed = (d.collect() for d in seen)
    trusted = quality_rules.trusted_ids(read_labels(spark, SF, "quality"))
    verdict = {r.doc_id: r.kept for r in quality_rules.judge(docs, trusted).collect()}
    assert {r.doc_id for r in good} == {d for d, k in verdict.items() if k}
    assert all(not brute.rule_counts(r.text)["base_failed"] for r in good)
    rows = [(r.doc_id, r.text) for r in good]
    assert {r.doc_id: r.text for r in lined} == {d: t for (d, _), t in zip(rows, brute.dedup_lines(rows))}
    prints = [brute.fingerprint(r.text) for r in lined]
    root = brute.smallest_of_component(len(lined), [(i, j) for i in range(len(lined)) for j in range(i)
                                                    if bin(prints[i] ^ prints[j]).count("1") <= 2])
    least = {}
    for r, d in zip(root, lined):
        least[r] = min(least.get(r, d.doc_id), d.doc_id)
    assert {r.doc_id for r in one} == set(least.values())
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in one}
    assert sum(r.length for r in packed) == sum(
        len(corpus_pipeline_ids(r.text)) + 1 for r in mixed)
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").distinct().collect()} == {r.doc_id for r in mixed}


def corpus_pipeline_ids(text):
    from tokenizers import Tokenizer

    from plainsight.llm.queries import tokenizer_file

    corpus_pipeline_ids.tokenizer = getattr(corpus_pipeline_ids, "tokenizer", None) or Tokenizer.from_file(tokenizer_file())
    return corpus_pipeline_ids.tokenizer.encode(text, add_special_tokens=False).ids


def test_lines_of_clean_documents_stay(spark):
    docs = spark.createDataFrame([(1, "first line of one clean text\nsecond line of it right here"),
                                  (2, "quite another text with words\nand one more line of words")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()} == {r.doc_id: r.text for r in docs.collect()}
