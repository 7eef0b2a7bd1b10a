"""Every operator beside columns of clashing, dotted and helper names: crash-free, with the columns carried that it carries."""

import public_tokenizers

from surfacelab.llm import bpe, chat, language, mixing, quality_classifier, quality_rules, shingle_join, simhash, token_files, vector_join, warc
from surfacelab.llm.shared import new_path

EXTRA = ["a.b", "__text", "text_", "input", "score", "slot", "words_", "node", "fp", "label_"]


def with_extra(df):
    return df.selectExpr("*", *[f"{k} AS `{c}`" for k, c in enumerate(EXTRA)])


def test_documents(spark):
    rows = [(1, "the river was wide and the house stood", "en", 1, "clean"), (2, None, None, 0, None), (2, "", "en", None, "low"), (None, "la maison est grande", "fr", 1, "low"), (3, "the river was wide and the house stood", "en", 0, "clean")]
    docs = with_extra(spark.createDataFrame(rows, "doc_id long, text string, lang string, label int, domain string"))

    def carried(out, *replaced):
        assert [c for c in out.columns if c in EXTRA and c not in replaced] == [c for c in EXTRA if c not in replaced]
        got = out.collect()
        assert all(r[c] == k for r in got for k, c in enumerate(EXTRA) if c not in replaced)
        return got

    assert len(carried(quality_rules.quality_rules(docs).where("NOT kept"))) == 5
    assert len(carried(quality_classifier.score(docs, quality_classifier.train(docs, docs.select("doc_id", "label"))), "score")) == 5
    assert len(carried(language.identify(docs, language.train(docs)), "score")) == 5
    model = mixing.train(docs, docs.select("doc_id", "domain"))
    members = mixing.memberships(docs, model)
    assert len(carried(mixing.with_rates(members, mixing.solve(members, model.domains)))) == 5
    carried(mixing.mix(docs, docs.select("doc_id", "domain")))
    assert len(carried(bpe.digests(bpe.encode_decode(docs, bpe.vocabulary_path("word_bpe_49k.json"))))) == 5
    assert len(carried(simhash.keep_one(docs))) == len(carried(shingle_join.keep_one(docs))) == 3
    assert simhash.simhash_groups(docs).count() == 5
    path = new_path(spark, "names-tokens")
    token_files.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    assert token_files.read_documents(spark, path).count() == 5


def test_other_tables(spark):
    vectors = with_extra(spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, 0.1], 1)], "vec_id long, embedding array<float>, label int"))
    assert {r.component_id for r in vector_join.near_vectors(vectors).collect()} == {1}
    pages = with_extra(spark.createDataFrame([(1, "u", "x"), (2, "v", "x")], "page_id long, url string, html string"))
    path = new_path(spark, "names-warc")
    warc.write_warc(pages, path)
    assert sorted(r.record_type for r in warc.read_warc(spark, path).collect()) == ["response", "revisit"]
    turns = with_extra(spark.createDataFrame([(1, 0, "user", "q")], "conv_id long, turn long, role string, text string"))
    assert chat.format_chats(chat.turn_rows(turns)).count() == 1
