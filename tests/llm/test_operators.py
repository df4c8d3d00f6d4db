"""Operators against brute force, libraries and SQL, on the tables and on rows with every oddity."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from parcelflow.llm import binary_codes, chats, language_id, license_texts, licenses, mixing, near_duplicates, neighbours, pieces, quality, queries, token_files

from ..compare import connection, rows, same

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept_id long, row string, size int, key string"
MODEL, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
GOOD = "The Small house stands near the river, and people walk by it daily. "


def odd_docs(spark):
    """Nulls in any column, empty and long texts, repeated rows and ids, and clashing column names."""
    long = " ".join(f"word{i % 977} and {i}" for i in range(60_000))
    values = [(1, GOOD * 3, "en", "a"), (1, GOOD * 3, "en", "a"), (1, "another text of the same id, still fine.", None, None), (2, None, "en", "b"), (3, "", None, ""), (None, GOOD, "fr", None), (4, " \t\n", "de", "b"), (5, long, "en", "b"), (6, "12 34", None, "é"), (7, "日本語 テキスト 😀 \x00 \x1f", None, "c"), (8, "Uno dos tres.", "es", "c")]
    return spark.createDataFrame([(i, t, lang, s, None, 9, "r", 1, "k") for i, t, lang, s in values], DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, name):
    same(queries.queries()[name](spark, sf_dir), connection(sf_dir), queries.oracle_sql()[name])


# 1: token files


def test_token_files_are_the_library_s_ids(spark, sf_dir):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    for docs in (spark.read.parquet(f"{sf_dir}/documents.parquet"), odd_docs(spark)):
        found = sorted(token_files.token_file_digest(docs, WORDS).collect(), key=lambda r: r.start)
        ids = [r.doc_id for r in found]
        assert ids == sorted(ids, key=lambda i: (i is not None, i))
        start, texts = 0, {}
        for r in docs.select("doc_id", "text").collect():
            texts.setdefault(r.doc_id, []).append(r.text or "")
        for r in found:
            assert r.start == start
            start += r.n_tokens
            encoded = [library.encode(t, add_special_tokens=False).ids + [1] for t in texts[r.doc_id]]
            assert (r.n_tokens, r.ids_crc32) in {(len(e), zlib.crc32(struct.pack(f"<{len(e)}I", *e))) for e in encoded}
    assert token_files.token_file_digest(no_docs(spark), WORDS).count() == 0


def test_token_files_don_t_depend_on_the_input_s_order(spark):
    made = [(1, f"word {k % 5} of one document " * (k % 7)) for k in range(60)] + [(None, "x"), (None, None), (2, "é")]
    found = [sorted(map(tuple, token_files.token_file_digest(spark.createDataFrame(m, "doc_id long, text string").repartition(n), WORDS).collect()), key=str) for m, n in ((made, 1), (made[::-1], 3))]
    assert found[0] == found[1]


def test_token_files_can_be_read_selectively(spark, sf_dir, tmp_path):
    import pyarrow.parquet as pq

    out = str(tmp_path / "tokens")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    token_files.write_token_files(docs, out, WORDS, row_group_bytes=1 << 16, page_bytes=1 << 12)
    groups = []
    for file in sorted(tmp_path.glob("tokens/*.parquet")):
        meta = pq.ParquetFile(file).metadata
        groups.append(meta.num_row_groups)
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(k).path_in_schema: meta.row_group(g).column(k) for k in range(meta.num_columns)}
            ids = next(c for name, c in columns.items() if name.startswith("ids."))
            assert ids.has_dictionary_page and ids.has_offset_index and all(columns[c].has_column_index and columns[c].has_offset_index for c in ("doc_id", "n_tokens", "offset"))
            assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and "DELTA_BINARY_PACKED" in columns["n_tokens"].encodings
    assert max(groups) > 1
    some = token_files.read_tokens(spark, out, 10, 30, ("doc_id", "n_tokens"))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,10)" in plan and "LessThanOrEqual(doc_id,30)" in plan and "ids" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert {r.doc_id for r in some.collect()} == {r.doc_id for r in docs.where("doc_id between 10 and 30").collect()}


# 2: near duplicates


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(docs):
    sets, up = [(i, shingles(t)) for i, t in docs if i is not None], {i: i for i, _ in docs if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {i: root(i) for i in up}


def test_near_duplicates_are_those_of_brute_force(spark, sf_dir):
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    made = [(i, " ".join(w if rng.random() > 0.004 * (i % 9) else "changed" for w in base)) for i in range(60)]
    made += [(100 + i, " ".join(base)) for i in range(30)] + [(200, "a b"), (201, "A\tb"), (202, ""), (203, None), (None, "a b")]
    tables = [spark.createDataFrame(made, "doc_id long, text string"), spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")]
    for docs in tables:
        texts = [tuple(r) for r in docs.collect()]
        want, sizes = brute_components(texts), {i: len(shingles(t)) for i, t in texts}
        for r in near_duplicates.near_duplicates(docs).collect():
            if r.doc_id is None:
                assert r.component_id is None and r.kept
            else:
                assert (r.n_shingles, r.component_id, r.kept) == (sizes[r.doc_id], want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_near_duplicates_of_odd_rows(spark):
    assert near_duplicates.near_duplicates(no_docs(spark)).count() == 0
    kept = near_duplicates.keep_one_of_each(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns
    # Of the two equal rows of document 1 and its other text one is left; rows without words stay.
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 3, None, 4, 5, 6, 7, 8], key=str)


# 3: nearest neighbours


def test_neighbours_reach_the_recall(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    table = vectors.toPandas().sort_values("vec_id")
    ids, x = table.vec_id.to_numpy(), np.stack(table.embedding).astype(float)
    found = neighbours.nearest(vectors).toPandas()
    hits = 0
    for q, own in found.groupby("query_id"):
        score = x @ x[ids == q][0]
        best = [i for i in ids[np.lexsort((ids, -score))] if i != q][:20]
        assert sorted(own["rank"]) == list(range(1, 21)) and q not in set(own.vec_id)
        assert np.allclose(own.score, [score[ids == v][0] for v in own.vec_id], atol=1e-12)
        hits += len(set(best) & set(own.vec_id))
    assert set(found.query_id) == set(ids[ids % 20 == 0]) and hits >= 0.9 * len(found)


def test_the_share_of_candidates_falls_as_the_table_grows(spark, sf_dir):
    share = []
    for d in (sf_dir, f"{sf_dir}/../sf0.1"):
        rows = neighbours.usable(spark.read.parquet(f"{d}/embeddings.parquet")).mapInArrow(neighbours._band_batches, "id long, vector array<double>, band int").cache()
        queries = rows.where("id % 20 = 0")
        pairs = neighbours.candidates(rows, queries, 20, (1, 1)).select("id", F.explode("ids")).distinct()
        share.append(pairs.count() / (queries.count() * rows.count()))
    assert share[1] < 0.85 * share[0] < 0.5


def test_equal_and_huge_vectors(spark):
    v = [(i, [1.0, 2.0, 3.0]) for i in range(100)] + [(100 + i, [1e200 * (i + 1), -1e200, 0.0]) for i in range(3)] + [(103, [1e308, 1e308, 0.0])]
    found = neighbours.nearest(spark.createDataFrame(v, "vec_id long, embedding array<double>"), 5).collect()
    of = lambda q: [(r.vec_id, r.score) for r in sorted(found) if r.query_id == q]
    assert of(100) == [(101, float("inf")), (102, float("inf")), (103, 0.0), (0, -1e200), (1, -1e200)]
    assert [i for i, _ in of(0)] == [103, 102, 1, 2, 3] and [i for i, _ in of(20)] == [103, 102, 0, 1, 2]


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    v = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [-9.0, 0.1]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (10, [1.0]), (None, [1.0, 0.0]), (20, [0.5, 0.5])]
    df = spark.createDataFrame([(i, x, 0, 0) for i, x in v], "vec_id long, embedding array<double>, id int, vector int")
    found = sorted(neighbours.nearest(df).collect())
    assert [tuple(r)[:3] for r in found if r.query_id == 0] == [(0, 1, 1), (0, 2, 2), (0, 3, 20), (0, 4, 3)]
    assert neighbours.nearest(df.limit(0)).count() == 0


# 4: mixing


def test_mix_of_odd_rows(spark):
    docs = odd_docs(spark)
    report = [r.asDict() for r in mixing.mix_report(docs).collect()]
    assert all(0 <= r["taken"] <= 3 * r["size"] and r["target"] <= 3 * r["source_size"] + 1e-9 for r in report)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in report)
    assert mixing.mix(no_docs(spark)).count() == 0
    assert rows(["a"], [(str(r),) for r in mixed.collect()]) == rows(["a"], [(str(r),) for r in mixing.mix(docs.repartition(3)).collect()])


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, "w " * rng.randrange(1, 40), "abcd"[min(3, int(rng.random() * 5))]) for i in range(4000)], "doc_id long, text string, source string")
    for r in mixing.mix_report(docs).groupBy("source_size").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken - r.target) <= 0.01 * r.target + 40


# 5: exact top-k of codes


def test_codes_are_searched_exactly(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 70))
    v[40:80] = v[0]
    values = [(i, x.tolist()) for i, x in enumerate(v)] + [(20, [0.0] * 70), (None, [1.0]), (301, None), (302, []), (303, [float("nan")])]
    df = spark.createDataFrame(values, "vec_id long, embedding array<double>")
    code = {i: "".join(str(sum(x[j] > 0 for j in range(b, 70, 64)) % 2) for b in range(64)) for i, x in [(i, max(y for k, y in values if k == i)) for i in range(300)]}
    want = [(q, n + 1, i, d) for q in range(0, 300, 20) for n, (d, i) in enumerate(sorted((sum(a != b for a, b in zip(code[q], code[i], strict=True)), i) for i in code if i != q)[:20])]
    assert sorted(tuple(r) for r in binary_codes.nearest_codes(df).collect()) == want
    assert binary_codes.nearest_codes(df.limit(0)).count() == 0


# 6: language


def test_language_of_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = {r.doc_id: r for r in language_id.language_report(docs).collect()}
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [i for i in lang if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all(found[i].held_out for i in held) and sum(r.held_out for r in found.values()) == len(held)
    assert sum(found[i].lang_pred == lang[i] for i in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in found.values())


def test_language_of_odd_rows(spark):
    found = language_id.language_report(odd_docs(spark)).collect()
    assert len(found) == 11 and all((r.lang_pred == "und") == (r.score == 0.0) for r in found)
    assert {r.lang_pred for r in found if r.doc_id in (2, 3, 4, 6)} == {"und"}
    kept = language_id.keep_identified(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns and not {r.doc_id for r in kept.collect()} & {2, 3, 4, 6}
    assert language_id.language_report(no_docs(spark)).count() == 0
    unlabelled = odd_docs(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.language_report(unlabelled).collect()} == {"und"}


def test_pieces_of_a_text_count_as_the_whole(monkeypatch):
    text = "Schöne Grüße aus Köln, ΣΑΣ 12 -- ὈΔΥΣΣΕΎΣ! " * 400
    whole = language_id.counts_of(text)
    for piece in (1, 7, 1000, 1003):
        monkeypatch.setattr(language_id, "PIECE", piece)
        cut = language_id.counts_of(text)
        assert whole[1] == cut[1] and (whole[0] == cut[0]).all(), piece


def naive_grams(text):
    """Counts of the 2- and 3-grams of a space, the letters with single spaces between, and a space; by their bucket."""
    points = [32]
    for c in text.lower():
        letter = "a" <= c <= "z" if ord(c) < 128 else ord(c) >= 0xAA and c.isalpha()
        if letter or points[-1] != 32:
            points.append(ord(c) if letter else 32)
    if points[-1] != 32:
        points.append(32)
    counts, top = [0] * language_id.DIMS, 2**64
    for k in range(len(points) - 1):
        two = ((points[k] + 1) * 0x9E3779B97F4A7C15 + (points[k + 1] + 1) * 0xC2B2AE3D27D4EB4F) % top
        grams = [two] + ([(two * 0xFF51AFD7ED558CCD + (points[k + 2] + 1) * 0x165667B19E3779F9) % top] if k + 2 < len(points) else [])
        for h in grams:
            counts[((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 % top) >> (64 - 13)] += 1
    return counts


def test_language_is_that_of_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang is not null")
    model = language_id.fit(docs)
    assert len(model.rows) <= language_id.CENTROIDS * len(set(model.langs)) and np.allclose(np.linalg.norm(model.rows, axis=1), 1, atol=1e-5)
    for r in language_id.identify(docs, model).join(docs.withColumnRenamed("doc_id", "i"), F.col("doc_id") == F.col("i")).limit(40).collect():
        counts = naive_grams(r.text)
        assert counts == language_id.counts_of(r.text)[0].tolist()
        v = [math.log1p(n) * w for n, w in zip(counts, model.idf.tolist(), strict=True)]
        length = math.sqrt(sum(x * x for x in v))
        cosines = [sum(x * y for x, y in zip(v, c, strict=True)) / length for c in model.rows.tolist()]
        best = max(range(len(cosines)), key=lambda k: (cosines[k], -k))
        letters = sum(c.isalpha() for c in r.text.lower())
        band = sum(letters >= b for b in language_id.BANDS)
        assert r.lang_pred == model.langs[best] and abs(r.score - min(1, max(0, cosines[best]))) < 1e-4
        assert r.rejected == (cosines[best] < model.least[best][band]) or abs(cosines[best] - model.least[best][band]) < 1e-4


# 7: chats


def test_masks_cover_the_speaker_s_own_words(spark):
    turns = [(1, 0, "system", "be nice"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob", None), (1, 2, "bob", None), (1, None, None, "?"), (1, 600, "ann", "late"), (None, 1, "ann", "alone"), (2, 0, "system", "x")]
    df = spark.createDataFrame([(*t, "z") for t in turns], "conv_id long, turn long, role string, text string, speaker string")
    found = {(r.conv_id, r.speaker, r.part): r for r in chats.rotated(df).collect()}
    assert set(found) == {(1, "ann", 0), (1, "bob", 0), (None, "ann", 0)}
    ann = found[1, "ann", 0]
    assert ann.text == "<|user|>?<|end|><|system|>be nice<|end|><|assistant|>hi < |end|><|end|><|user:bob|><|end|><|user:bob|><|end|><|assistant|>late<|end|>" and ann.n_turns == 6
    assert [ann.text[int(a) : int(b)] for a, b in (s.split("-") for s in ann.mask.split(","))] == ["hi < |end|><|end|>", "late<|end|>"]
    bob = found[1, "bob", 0]
    assert [bob.text[int(a) : int(b)] for a, b in (s.split("-") for s in bob.mask.split(","))] == ["<|end|>", "<|end|>"] and bob.n_masked == 14
    assert chats.rotated(df.limit(0)).count() == 0


def test_parts_are_pieces_of_one_rendering(spark):
    long = "very long " * 50_000
    turns = [(1, None if k % 9 == 0 else k // 3, ["ann", "bob", "cy", "system"][k % 4], [f"t{k}", "same", None][k % 3]) for k in range(60)] + [(1, 3, "ann", long)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    rows = lambda x: sorted(map(str, x.select("conv_id", "speaker", "text", "mask").collect()))
    parts = chats.rotated(df, 7)
    assert parts.groupBy("speaker").count().where("count <> 9").count() == 0 and {r.n_parts for r in parts.collect()} == {9}
    assert rows(chats.whole(parts)) == rows(chats.rotated(df))


# 8: licenses


def test_licenses_are_inherited_from_the_nearest_directory(spark):
    mit, apache = "Released under the MIT License.", "// Licensed under the Apache License, Version 2.0. Words follow"
    files = [(1, "a/LICENSE", mit), (2, "a/b/c/x.py", "no words"), (3, "a/b/LICENSE.txt", apache), (4, "a/y.py", None), (5, "z/q.py", ""), (6, None, mit), (7, "a/b/own.py", f"text\n{mit}"), (8, "a/b/own.py", "same path"), (9, None, None), (None, "a/n.py", "license to nothing at all in particular")]
    df = spark.createDataFrame([(*f, 1, "d") for f in files], "id long, path string, text string, key int, dir string")
    found = {r.id: (r.license, r.how, r.source_path) for r in licenses.scan_licenses(df).collect()}
    assert found == {1: ("MIT", "header", "a/LICENSE"), 2: ("Apache-2.0", "inherited", "a/b"), 3: ("Apache-2.0", "header", "a/b/LICENSE.txt"), 4: ("MIT", "inherited", "a"), 5: (None, "none", None), 6: ("MIT", "header", None), 7: ("MIT", "header", "a/b/own.py"), 8: ("MIT", "header", "a/b/own.py"), 9: (None, "none", None), None: ("MIT", "inherited", "a")}
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_licenses_that_are_alike(spark):
    cases = {
        "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0", "Licensed under CC BY-ND 4.0": "CC-BY-ND-4.0", "Licensed under CC BY 4.0": "CC-BY-4.0", "Licensed under CC BY 2.0": None,
        "GNU General Public License, version 2": "GPL-2.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3": "LGPL-3.0", "# GNU GENERAL PUBLIC LICENSE\n#    Version 3, 29 June 2007": "GPL-3.0",
        "SPDX-License-Identifier: MIT": "MIT", "// SPDX-License-Identifier: BSD-2-Clause": "BSD-2-Clause", "SPDX-License-Identifier: AGPL-3.0-only": "AGPL-3.0", "SPDX-License-Identifier: Foo-1.0": None,
        "BSD 2-Clause License": "BSD-2-Clause", "BSD 3-Clause License": "BSD-3-Clause", "ISC License": "ISC", "Mozilla Public License Version 2.0": "MPL-2.0", "Mozilla Public License Version 1.1": "MPL-1.1", "Licensed under the Foo License.": None,
    }
    whole = {i: f"{i}\n\nCopyright (c) 2020 Some One\n\n{t}" for i, t in license_texts.WHOLE}
    files = [(k, f"a{k}/x.py", t) for k, t in enumerate(cases)] + [(100 + k, f"b{k}/LICENSE", t) for k, t in enumerate(whole.values())] + [(200, "c/x.txt", "no license words " * 50_000)]
    found = {r.id: r.license for r in licenses.scan_licenses(spark.createDataFrame(files, "id long, path string, text string")).collect()}
    assert {t: found[k] for k, t in enumerate(cases)} == cases
    assert [found[100 + k] for k in range(len(whole))] == list(whole) and found[200] is None


def test_nothing_is_inherited_from_host_to_host(spark):
    mit = "<p>Released under the MIT License.</p>"
    pages = [(1, "https://one.example", mit), (2, "https://one.example/a/b", "<p>x</p>"), (3, "https://two.example", "<p>x</p>"), (4, "https://two.example/a", "y"), (5, None, mit), (6, "http://one.example/c?q=1", None)]
    found = {r.page_id: (r.license, r.how) for r in licenses.scan_pages(spark, spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert found == {1: ("MIT", "header"), 2: ("MIT", "inherited"), 3: (None, "none"), 4: (None, "none"), 5: ("MIT", "header"), 6: ("MIT", "inherited")}


# 9: quality


def test_quality_drops_junk_and_keeps_clean_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/../sf0.01/labels.parquet").collect()}
    kept = {r.doc_id: r.kept for r in quality.quality_report(docs).collect()}
    clean, junk = ([kept[i] for i, q in labels.items() if q == want] for want in (1, 0))
    assert np.mean(clean) >= 0.98 and np.mean(junk) <= 0.15


def test_quality_of_odd_rows(spark):
    found = quality.quality_report(odd_docs(spark)).collect()
    assert len(found) == 11 and all(r.score == 0 and not r.kept for r in found if r.doc_id in (2, 3, 4))
    kept = quality.keep_clean(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns and {r.doc_id for r in kept.collect()} >= {1, None}
    assert quality.quality_report(no_docs(spark)).count() == 0


def test_measures_of_pieces_add_up(monkeypatch):
    text = ("one two two THREE!! four | five. ßé five, two " + "x" * 90) * 60
    whole = quality.measures([text, "", None])
    for piece in (1, 50, 1000):
        monkeypatch.setattr(quality, "PIECE", piece)
        cut = quality.measures([text, "", None])
        assert all((a == b).all() for a, b in zip(whole, cut, strict=True)) and not whole[0][1:].any()
    assert (quality.measures(["another", text])[1][1] == whole[1][0]).all()


def naive_posteriors(votes, rounds=60):
    """The same estimate by a loop over documents: votes of 0 junk, 1 nothing, 2 clean."""
    clean = [0.1 if 0 in v else 0.95 if 2 in v else 0.5 for v in votes]
    for _ in range(rounds):
        share = min(0.99, max(0.01, sum(clean) / len(clean)))
        chance = []
        for k in range(quality.LABELLERS):
            rows = []
            for weight in ([1 - c for c in clean], clean):
                seen = [0.02 + sum(w for v, w in zip(votes, weight, strict=True) if v[k] == x) for x in range(3)]
                rows.append([x / sum(seen) for x in seen])
            for x, wrong in ((0, rows[1][0] > rows[0][0]), (2, rows[0][2] > rows[1][2])):
                if wrong:
                    rows[0][x] = rows[1][x] = (rows[0][x] + rows[1][x]) / 2
            chance.append(rows)
        odds = [[math.prod([p] + [chance[k][c][x] for k, x in enumerate(v)]) for c, p in ((0, 1 - share), (1, share))] for v in votes]
        clean = [b / (a + b) for a, b in odds]
    return clean


def test_posteriors_are_those_of_brute_force():
    rng = random.Random(6)
    votes = [[rng.choice([0, 1] if junk else [1, 1, 1, 0]) for _ in range(7)] + [rng.choice([1, 2] if not junk else [1, 1, 2]) for _ in range(2)] for junk in [rng.random() < 0.3 for _ in range(300)]]
    patterns = [int(x) for x in quality.pattern_of(np.array(votes) - 1)]
    found = quality.estimate(Counter(patterns))
    assert all(abs(found[p] - c) < 1e-6 for p, c in zip(patterns, naive_posteriors(votes), strict=True))


def naive_score(text, weights):
    """The linear score with features hashed word by word and character by character."""
    top, shapes, words = 2**64, Counter(), re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
    mixed = lambda x: (((y := (x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 % top) ^ (y >> 32)) * 0x94D049BB133111EB) % top
    hashes = [int(near_duplicates.word_hashes(w)[0][0]) for w in words]
    kinds = [0] + [int(quality._KINDS[b]) for b in text.encode()] + [0]
    for k in range(1, len(kinds) - 1):
        shapes[mixed((kinds[k - 1] * 16 + kinds[k]) * 16 + kinds[k + 1] + (1 << 40)) >> 52] += 1
    both = Counter(h >> 52 for h in hashes) + Counter(mixed((a * 3 + b) % top) >> 52 for a, b in zip(hashes, hashes[1:], strict=False))
    again = sum(a == b for a, b in zip(hashes, hashes[1:], strict=False))
    size, many = sum(shapes.values()) + quality.SMOOTH, sum(both.values()) + quality.SMOOTH
    z = weights[-1] + weights[-2] * math.sqrt(again / size) + sum(weights[b] * math.sqrt(n / size) for b, n in shapes.items())
    z += sum(weights[quality.SHAPE_DIMS + b] * quality.WORD_WEIGHT * math.sqrt(n / many) for b, n in both.items())
    return 1 / (1 + math.exp(-z))


def test_scores_are_those_of_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(trim(text)) > 0").limit(60)
    weights = quality.fit(docs)
    texts = [r.text for r in docs.collect()]
    found = {r.doc_id: r.score for r in quality.scores(docs, weights).collect()}
    assert len(found) == len(texts) and all(abs(found[r.doc_id] - naive_score(r.text, weights.tolist())) < 1e-9 for r in docs.collect())


def test_posteriors_tell_the_classes_apart():
    votes = lambda bad, good: int(quality.pattern_of(np.array([[-1] * bad + [0] * (7 - bad) + [1] * good + [0] * (2 - good)]))[0])
    found = quality.estimate({votes(0, 2): 900, votes(1, 2): 40, votes(2, 1): 60})
    assert found[votes(0, 2)] > 0.9 and found[votes(2, 1)] < 0.1 and quality.estimate({}) == {}


# 10: pieces


def test_pieces_are_the_library_s(spark, sf_dir):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for docs in (spark.read.parquet(f"{sf_dir}/documents.parquet"), odd_docs(spark)):
        texts = {}
        for r in docs.select("doc_id", "text").collect():
            texts.setdefault(r.doc_id, []).append(r.text or "")
        for r in pieces.piece_digest(docs, MODEL).collect():
            want = set()
            for t in texts[r.doc_id]:
                ids = library.encode(t, add_bos=True, add_eos=True)
                want.add((len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) in want
    assert pieces.piece_digest(no_docs(spark), MODEL).count() == 0


def test_pieces_of_random_texts(spark):
    import sentencepiece

    library, encoder, rng = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.piece_encoder(MODEL), random.Random(2)
    assert pieces.decode_pieces(pieces.encode_pieces(spark.createDataFrame([(1, "ab  c 日"), (2, None)], "doc_id long, text string"), MODEL), MODEL).select("text").collect() == [("ab  c 日",), ("",)]
    for _ in range(1500):
        text = "".join(rng.choice("abc the  ▁\n\tßé中😀xX1.,'‍ ") for _ in range(rng.randrange(50)))
        assert struct.unpack(f"<{len(encoder.encode(text)) // 4}I", encoder.encode(text)) == tuple(library.encode(text))


# The pipeline


def test_pipeline_stages_follow_each_other(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs, columns = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    columns, sizes = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.toPandas(), docs.schema)
        sizes.append(docs.count())
    want = {(r.doc_id, r.ids_sha256) for r in pieces.piece_digest(docs, MODEL).collect()}
    found = corpus_pipeline.run(spark, sf_dir).collect()
    assert len(found) == sizes[-1] and {(r.doc_id, r.ids_sha256) for r in found} == want
    assert sizes[0] >= sizes[1] >= sizes[2]
    ends = odd_docs(spark)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs(spark), sf_dir).count() == 0
        ends = stage(spark, ends, sf_dir)
    assert ends.count() > 0
