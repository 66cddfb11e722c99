"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from aislewise.llm import (chat, classifier, exact, mixing, packing, paragraphs, pii, rules,
                           simhash, warc)

SCHEMA = ("doc_id long, text string, source string, id long, row string, size long, fp long, "
          "node long, kept boolean, digest string, `group` long, place long, copies long, h long")
LONG = " ".join(f"word{k % 997} other{k % 1013}." for k in range(60_000))
TEXTS = [(1, "one two three four five six seven"), (2, None), (3, ""), (4, " \n\t "), (5, LONG),
         (6, "one two three four five six seven"), (7, "a"), (None, "no id here at all"),
         (8, "same row"), (8, "same row"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if k % 3 == 0 else "src", 99, "r", 5, 6, 7, True, "d", 8, 9, 10, 11)
            for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, 0) for k in range(1, 9)] + [(1, None, None)],
                                 "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("doc_id = -1")


def per_row(docs, labels):
    return {
        "exact": exact.duplicates(docs), "simhash": simhash.near_duplicates(docs),
        "rules": rules.assess(docs), "pii": pii.pseudonymise(docs, b"k"),
        "mixing": mixing.mix(docs), "classifier": classifier.assess(docs, labels)}


def test_one_row_per_document(docs, labels):
    for name, found in per_row(docs, labels).items():
        assert found.count() == len(TEXTS), name


def test_empty_tables(docs, nothing, labels):
    for name, found in per_row(nothing, labels).items():
        assert found.count() == 0, name
    assert classifier.assess(docs, labels.where("doc_id = -1")).agg(
        F.min("score"), F.max("score")).first()[:] == (0.5, 0.5)
    assert packing.packed(nothing, "word_bpe_49k.json").count() == 0
    assert paragraphs.repeated(nothing).count() == 0
    for whole in (exact.deduplicate, simhash.deduplicate, rules.clean, paragraphs.remove):
        assert whole(nothing).columns == nothing.columns and whole(nothing).count() == 0
    turns = nothing.select(F.col("doc_id").alias("conv_id"), F.col("id").alias("turn"),
                           F.col("row").alias("role"), "text")
    assert chat.read_back(chat.examples(turns)).count() == 0
    pages = nothing.select(F.col("doc_id").alias("page_id"), F.col("row").alias("url"),
                           F.col("text").alias("html"))
    assert warc.captures(pages).count() == 0


def test_exact_keeps_one_of_each_text(docs):
    found = exact.duplicates(docs).collect()
    of = {(r.id, bytes(r.digest)): r for r in found}
    assert sum(r.kept for r in found) == 7
    one = next(r for r in found if r.id == 1)
    assert (one.keep_id, one.group_size, one.kept) == (6, 2, False)
    empty = next(r for r in found if r.id == 2)
    assert (empty.keep_id, empty.group_size) == (3, 3) and not empty.kept
    assert len(of) == len(TEXTS) - 1  # the repeated row
    assert sorted(r.kept for r in found if r.id == 8) == [False, True]
    kept = exact.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == 7
    assert kept.where("doc_id = 8").first()["group"] == 8


def test_exact_is_the_same_without_frequent_texts(docs):
    wide, narrow = exact.duplicates(docs), exact.duplicates(docs, top=1, tracked=8)
    assert sorted(map(str, wide.collect())) == sorted(map(str, narrow.collect()))


def test_simhash_classes(docs):
    found = simhash.near_duplicates(docs).collect()
    none = [r for r in found if r.id in (2, 3, 4)]
    assert {(r.fp, r.component_id) for r in none} == {(0, 2)}
    assert {r.component_id for r in found if r.id in (1, 6)} == {1}
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [
        (False, 1), (False, 2), (False, 5), (False, 7), (False, 8), (True, 0)]


def test_mixing_caps_and_repeats(docs):
    mixed = mixing.mix(docs)
    assert mixed.agg(F.min("copies"), F.max("copies")).first()[1] <= 2
    sizes = {r[0]: r[1:] for r in mixed.groupBy("source").agg(
        F.sum("size"), F.first("source_size"), F.first("target")).collect()}
    for total, stated, target in sizes.values():
        assert total == stated and target <= 2 * total
    again = mixing.mix(docs)
    key = lambda rows: sorted(str((r.row.doc_id, r.size, r.copies)) for r in rows)
    assert key(mixed.collect()) == key(again.collect())
    taken = mixing.materialise(mixed, docs.columns)
    assert taken.columns == docs.columns
    assert taken.count() == mixed.agg(F.sum("copies")).first()[0]
    wordless = docs.where("doc_id IN (2, 3, 4)")
    assert mixing.mix(wordless).agg(F.max("target")).first()[0] == 0


def test_packing_covers_every_id(docs):
    found = packing.packed(docs, "word_bpe_49k.json").collect()
    by = {}
    for r in found:
        by.setdefault((r.id, r.tokens), []).append(r)
    assert {r.tokens for r in found if r.id in (2, 3, 4)} == {1}
    assert len([r for r in found if r.id == 8]) == 2
    for (name, total), rows in by.items():
        times = 2 if name == 8 else 1
        assert sum(r.length for r in rows) == total * times


def test_rules_on_awkward_rows(docs):
    found = {(r.id, r.n_words): r for r in rules.assess(docs).collect()}
    assert found[(2, 0)].base_failed and not found[(2, 0)].kept
    long = found[(5, 120_000)]
    assert long.base_failed == (100 * long.n_repeat_words > 50 * long.n_words)
    assert rules.clean(docs).columns == docs.columns


def test_rules_judge_every_row_by_its_own_text(spark):
    """Ids repeat and are null; rows stay as many as ``assess`` keeps, each with its own text."""
    body = "\n".join(f"line {k} " + " ".join(f"w{j}x{k}" for j in range(30)) for k in range(4))
    rows = [(1, body), (1, body + "\nextra words here"), (1, body), (None, body + "\nno id"),
            (None, "short"), (2, None)]
    docs = spark.createDataFrame([(i, t, None if k == 3 else "h") for k, (i, t) in enumerate(rows)],
                                 "doc_id long, text string, source string")
    assert rules.assess(docs).where("kept").count() == 4
    assert sorted(r.text for r in rules.clean(docs).collect()) == sorted(
        t for _, t in rows if t and len(t) > 99)


def test_a_line_on_a_small_share_of_a_large_host_goes(spark):
    docs = spark.range(10_000).selectExpr(
        "id AS doc_id", "concat_ws(' ', transform(sequence(1, 60), k -> concat('w', k, 'x', id)),"
        " if(id % 11 = 0, '\nthe shared line', '\nanother ' || id)) AS text", "'h' AS source")
    gone = rules.assess(docs).groupBy("removed_words").count().collect()
    assert sorted(map(tuple, gone)) == [(0, 9090), (3, 910)]


def test_paragraphs_and_pii_keep_columns(docs):
    unique = docs.where("doc_id <> 8")
    assert paragraphs.remove(unique).columns == docs.columns
    assert paragraphs.remove(unique).count() == unique.count()
    red = pii.redact(docs, b"k")
    assert red.columns == docs.columns
    assert red.where("doc_id = 2").first().text is None


def test_quality_stage_keeps_columns(docs, labels):
    assert classifier.keep_good(docs, labels, threshold=0.0).columns == docs.columns
    assert classifier.keep_good(docs, labels, threshold=0.0).count() == len(TEXTS)


def test_chat_awkward_turns(spark):
    rows = spark.createDataFrame(
        [(1, 0, "user", None), (1, 1, "assistant", ""), (1, 1, "assistant", ""),
         (2, None, None, "<|im_end|>\n x"), (None, 0, "assistant", "a\nb"),
         (3, 0, "two\nlines%0A", "t"), (3, 1, "user", LONG)],
        "conv_id long, turn long, role string, text string")
    found = {r.conv_id: r for r in chat.read_back(chat.examples(rows)).collect()}
    assert found[1].n_turns == 3 and found[1].loss_chars == 0
    assert found[2].n_turns == 1 and found[2].loss_chars == 0
    assert found[None].loss_chars == 3 and found[3].n_turns == 2
    import hashlib
    wanted = f"two\nlines%0A\nt\nuser\n{LONG}\n"
    assert found[3].turns_sha256 == hashlib.sha256(wanted.encode()).hexdigest()


def test_warc_awkward_pages(spark):
    body = "x\r\n\r\nWARC/1.1\r\n" * 20
    rows = spark.createDataFrame(
        [(1, "http://a/\r\nEvil: 1", body), (2, None, body), (2, None, body), (3, "u", None),
         (4, "u", "é" * 50), (5, "u", "é" * 50), (6, "u", "s"), (7, "u", "s"), (None, "u", body),
         (8, "u", LONG)],
        "page_id long, url string, html string")
    found = warc.captures(rows.withColumn("digest", F.lit(1))).collect()
    assert len(found) == rows.count()
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in found)
    assert kinds == [(0, "revisit", 1), (1, "response", 0), (2, "revisit", 1), (2, "revisit", 1),
                     (3, "response", 0), (4, "response", 0), (5, "revisit", 4), (6, "response", 0),
                     (7, "response", 0), (8, "response", 0)]
    sizes = {r.page_id: r.payload_bytes for r in found}
    assert sizes[3] == 0 and sizes[5] == 100 and sizes[2] == len(body)
