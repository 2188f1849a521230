"""The pipeline stage by stage against brute force, and its entry."""

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from corvane.llm import toxicity
from corvane.llm.exact_dedup import lower_az
from test_ngram_join import brute as near_brute

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages(spark, docs):
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    given = docs.collect()
    one = P.drop_toxic(spark, docs, SF).cache()
    assert one.columns == docs.columns
    assert rows(one) == sorted((tuple(r) for r in given if model.score(r.text or "") < 0.5), key=str)

    two = P.drop_copies(spark, one, SF).cache()
    best = {}
    for r in one.collect():
        k = lower_az(r.text)
        best[k] = max(best.get(k, r), r, key=lambda r: r.doc_id)
    assert two.columns == docs.columns and rows(two) == sorted((tuple(r) for r in best.values()), key=str)

    three = P.drop_near_copies(spark, two, SF).cache()
    held = two.collect()
    stay = {i for i, n, c in near_brute([(r.doc_id, r.text) for r in held], 5, 80, 100) if n == 0 or i == c}
    assert three.columns == docs.columns and rows(three) == sorted((tuple(r) for r in held if r.doc_id in stay), key=str)

    four = P.blank_secrets(spark, three, SF).cache()
    assert four.columns == docs.columns and four.count() == three.count()
    assert four.filter("n_chars != length(text)").count() == 0

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r.doc_id: len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for r in four.collect()}
    for out in (P.pack_sequences(spark, four, SF), P.run(spark, SF)):
        assert {r.doc_id: r.n for r in out.groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()} == want


def test_odd_tables(spark, odd):
    extra = odd.selectExpr("*", "'s' source", "'en' lang", "0L n_chars", "1 __mark", "2 key", "3 tag", "4 kept")
    for df in (extra, extra.limit(0)):
        for _, stage in P.STAGES[:-1]:
            out = stage(spark, df, SF)
            assert out.columns == df.columns
            df = out.cache()
        P.pack_sequences(spark, df, SF).collect()
    texts = [r.text for r in P.drop_copies(spark, extra, SF).collect()]
    assert len(texts) == len({lower_az(t) for t in texts}) == len({lower_az(r.text) for r in extra.collect()})
