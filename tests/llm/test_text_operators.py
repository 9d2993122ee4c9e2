import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from datetime import date

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.compare import same
from tidebar.llm import licenses, mixing, pii, quality, queries, tokens

WORDS = r"[^\x20\x09-\x0D]+"
LONG = "the quick brown fox jumps over the lazy dog and runs home again " * 3000
#: Null id, null text, empty, blank, ties, repeated rows, a very long text, odd characters.
ROWS = [
    (1, "Released under the MIT License.\nA b c d e f g h i j k l m n o p q r s t u v", "x"), (2, None, "x"), (3, "", None), (4, " \t\n ", "y"), (None, "null id here", "y"), (5, "same text twice", "y"), (6, "same text twice", "y"),
    (7, "one row repeated", "z"), (7, "one row repeated", "z"), (8, LONG, "z"), (9, "é 中文 😀 ’s\u00a0don't  two  spaces\r\n\x0b end ", "x"), (10, "a a a a a a a a a a a a a a a a a a a a a a a a", "x"), (11, "line\nline\n \nline", "x"),
]
SCHEMA = "doc_id long, text string, source string, size string, kept string, ids string, n_found string, score string, __w string, target string"


@pytest.fixture(scope="module")
def docs(spark):
    """With extra columns whose names clash with results."""
    return spark.createDataFrame([(*r, "s", "k", "i", "f", "c", "w", "t") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (8, 1, 0), (9, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")


def texts(spark, sf_dir):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def repeated_words(ws):
    seen = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    return len({j for i in range(len(ws) - 7) if seen[tuple(ws[i : i + 8])] > 1 for j in range(i, i + 8)})


def base_counts(text):
    ws = regex.findall(WORDS, text)
    lines = [x for x in text.split("\n") if regex.search(WORDS, x)]
    n, rep = len(ws), repeated_words(ws)
    return n, sum(map(len, ws)), len(regex.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), rep, n < 20 or 100 * rep > 30 * n


def test_quality_as_brute_force(spark, sf_dir):
    got = {r.doc_id: r for r in queries.QUERIES["op10_quality_rules"](spark, sf_dir).collect()}
    grams, h = {}, lambda b: xxhash.xxh64_intdigest(b, 42)
    for i, t in texts(spark, sf_dir):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_counts(t)
        one = [h(w.encode()) for w in regex.findall(WORDS, t)]
        # A hash of two longs: the second one seeded by the first.
        two = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42)) for a, b in zip(one, one[1:], strict=False)]
        grams[i] = [x % quality.BUCKETS for x in one + two]
    good = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()}
    raw, trusted = Counter(), Counter()
    for i, g in grams.items():
        raw.update(g)
        trusted.update(g if i in good else ())
    share = {b: (raw[b] + 1) / (raw.total() + quality.BUCKETS) for b in raw}
    ratio = {b: np.log((trusted[b] + quality.BUCKETS * share[b]) / (trusted.total() + quality.BUCKETS) / share[b]) for b in raw}
    for i, g in grams.items():
        if g:
            score = sum(ratio[b] for b in g) / len(g)
            assert abs(score - got[i].score) < 1e-9
            assert got[i].kept == (not got[i].base_failed and score >= quality.THRESHOLD)
    labelled = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert all(got[i].kept or got[i].base_failed for i, q in labelled.items() if q == 1)


def test_quality_of_odd_rows(docs, none, labels):
    out = quality.rules(docs, labels)
    rows = {(r.doc_id, r.text): r for r in out.collect()}
    assert out.count() == len(ROWS) and "__w" in out.columns
    for i, t, _ in ROWS:
        r = rows[i, t]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_counts(t or "")
    assert rows[2, None].score is None and not rows[2, None].kept
    assert quality.rules(none, labels).count() == 0
    assert quality.rules(docs, labels.limit(0)).where("score is not null").count() == 0


def test_mix_as_sql(spark, sf_dir):
    same(queries.QUERIES["op5_mix_sources"](spark, sf_dir), queries.SQL["op5_mix_sources"], sf_dir)


def test_mix_meets_targets(spark, sf_dir):
    sizes = mixing.sized(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    got = mixing.copies(sizes).groupBy("source").agg(F.sum(F.col("__copies") * F.col("size")).alias("taken"), F.max("target").alias("target"), F.max("size").alias("longest"), F.max("__copies").alias("most"), F.max("source_size").alias("all")).collect()
    assert abs(sum(r.target for r in got) - 1.5 * sum(r["all"] for r in got)) < 1e-6
    for r in got:
        assert abs(r.taken - r.target) <= r.longest and r.most <= 2 and r.target <= 2 * r["all"]


def test_mix_of_odd_rows(docs, none):
    out = mixing.mix(docs)
    assert out.columns == docs.columns and mixing.mix(none).count() == 0
    drawn = Counter((r.doc_id, r.text) for r in out.collect())
    rows = Counter((i, t) for i, t, _ in ROWS)
    assert all(n <= 2 * rows[k] for k, n in drawn.items()) and drawn == Counter((r.doc_id, r.text) for r in mixing.mix(docs).collect())
    assert mixing.copies(mixing.sized(docs)).count() == len(ROWS)


def own_ranks():
    import base64

    with open(public_tokenizers.path(tokens.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_as_the_other_library(spark, sf_dir):
    other, got = own_ranks(), {r.doc_id: r for r in queries.QUERIES["op4_byte_bpe"](spark, sf_dir).collect()}
    for i, t in texts(spark, sf_dir):
        ids = other.encode_ordinary(t)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


@pytest.mark.parametrize("name", [tokens.RANKS, tokens.MODEL])
def test_encoding_of_odd_rows(docs, none, name):
    path = public_tokenizers.path(name)
    out = tokens.encode(docs, path, with_offsets=True)
    plain = [r.ids for r in tokens.encode(docs, path).collect()]
    for r, ids in zip(out.collect(), plain, strict=True):
        assert r.ids == ids and len(r.starts) == len(ids) == len(r.ends)
        assert not ids or r.ends[-1] <= len(r.text)
    back = tokens.decode(tokens.encode(docs, path).drop("text"), path)
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((i, t or "") for i, t, _ in ROWS)
    assert tokens.encode(none, path).count() == 0


def test_pieces_are_cut_as_by_the_pattern():
    """Cut with and without the pattern, and encoded, pieces of letters, marks, numbers and line breaks give the library's ids."""
    codec, rng = tokens.Codec(public_tokenizers.path(tokens.MODEL)), random.Random(3)
    parts = ["a", "Word", "s", "é", "ß", "语", "'", "'s", ".", "!!", "_", "***", "\n", "\n\n", "7", "42", "²", "ª", "\u0301", "—", "\t", "\x00", "\u00a0"]
    pieces = ["".join(rng.choices(parts, k=rng.randint(1, 6))) for _ in range(4000)]
    for x in pieces:
        for lead in (" ", ""):
            assert x.isalpha() or codec._cut(x, lead) == codec.matches.findall(lead + x)
    texts = [" ".join(rng.choices(pieces, k=9)) for _ in range(500)]
    for _ in range(2):  # anew and remembered
        assert codec.encode(pa.array(texts)) == [np.asarray(codec.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_token_files(spark, sf_dir, docs, none):
    model = Tokenizer.from_file(public_tokenizers.path(tokens.MODEL))
    model.encode_special_tokens = True
    start = 0
    got = {r.doc_id: r for r in queries.QUERIES["op7_token_files"](spark, sf_dir).collect()}
    for i, t in sorted(texts(spark, sf_dir)):
        ids = [*model.encode(t, add_special_tokens=False).ids, 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_files_of_odd_rows(spark, tmp_path, docs, none):
    for name, df in (("odd", docs), ("none", none)):
        target = str(tmp_path / name)
        tokens.write_tokens(df, public_tokenizers.path(tokens.MODEL), target, partitions=3)
        rows = tokens.read_tokens(spark, target)
        assert rows.count() == df.count()
        found = sorted((r.start, r.n_tokens) for r in tokens.token_index(rows).collect())
        assert all(a + n == b for (a, n), (b, _) in zip(found, found[1:], strict=False))
    assert tokens.read_tokens(spark, str(tmp_path / "odd"), [7]).count() == 2


def test_licenses_as_brute_force(spark, docs, none):
    notes = ["Relased under the MTI License", "permission is hereby granted, free of charge, to any person obtaning a copy of this software", "licensed under the apache licence version 2.0", "All rights reservd", "nothing at all", "mit license mit license", "it licenses"]
    df = spark.createDataFrame([(i, f"some words before. {x}! And more after") for i, x in enumerate(notes)], "doc_id long, text string")
    for r in licenses.scan(df).join(df, "doc_id").collect():
        joined = b" ".join(licenses.normalised(r.text)).decode()
        want = {k for n, k in licenses.NOTICES if licenses.matcher(n).search(joined)} | {k for p, k in licenses.BASE if f" {p} " in f" {joined} "}
        assert set(filter(None, r.labels.split(","))) == want
        ws = joined.split()
        places = [i for p, _ in licenses.BASE for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(ws), len(places), min(places, default=None), max(places, default=None))
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert got[0].labels == "mit" and 0.8 < got[0].score < 1 and got[4].score == 0 and got[5].n_base == 2
    assert df.where("doc_id = 0").first().text[got[0].spans[0].start : got[0].spans[0].end] == "Relased under the MTI License"
    assert licenses.scan(docs).count() == len(ROWS) and licenses.scan(none).count() == 0


def test_notices_side_by_side():
    for text, want in (("all rights reservd all rights reserved", [1, 0]), ("released under the mit licence and released under the mit license", [1, 0]), ("all rigts reserved x all rights reserved", [1, 0]), ("All rights reserved. " * 500, [0] * 500)):
        spans = [x for x in licenses.scan_text(text)["spans"]]
        assert [x["edits"] for x in sorted(spans, key=lambda x: x["start"])] == want
        assert all(text[x["start"] : x["end"]].lower().startswith(x["notice"][:5]) for x in spans)
    assert licenses.scan_text("Licensed under CC BY-NC 4.0")["labels"] == "cc-by-nc"
    assert licenses.scan_text("Licensed under CC BY-SA 4.0")["labels"] == "cc-by-sa"


def test_licenses_of_all_documents(spark, sf_dir):
    """The query on the whole table; fuzzy search over whole texts, without pieces, on those that name a license and some others."""
    old = dict(texts(spark, sf_dir))
    got = {r.doc_id: r for r in queries.QUERIES["op3_license_scan"](spark, sf_dir).collect()}
    assert set(got) == set(old)
    for i, text in old.items():
        ws = re.sub("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", " ", text.translate({c: c + 32 for c in range(65, 91)})).split()
        places = [(j, k) for p, k in licenses.BASE for j in range(len(ws)) if ws[j : j + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(ws), len(places), min(places, default=(None,))[0], max(places, default=(None,))[0])
        assert r.base_labels == ",".join(sorted({k for _, k in places})) and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
        named = re.search("(?i)licen|reserv", text)
        if named and len(ws) < 400 or i % 40 == 0 and len(ws) < 100:
            for notice, _ in licenses.NOTICES:
                m = licenses.matcher(notice).search(" ".join(ws))
                assert bool(m) or all(x.notice != notice for x in r.spans)
                if m:
                    edits = sum(m.fuzzy_counts)
                    assert any(x.notice == notice and x.edits == edits for x in r.spans) or any(x.edits < edits for x in r.spans), (i, notice)
    assert any(r.spans for r in got.values())


def test_pseudonyms():
    assert len({pii.permuted(x, 1000, b"k", "t") for x in range(1000)}) == 1000
    assert all(pii.permuted(pii.permuted(x, 1000, b"k", "t"), 1000, b"k", "t", inverse=True) == x for x in range(1000))
    text = "On 2001-02-28 or 3/14/1999 or 31.12.2000: 123-45-6789, DE89 3704 0044 0532 0130 00, +1 (988) 555-2485, 4111-1111-1111-1111, jo.x7@a.example, 10.20.30.40, password=abc123def456"
    new, found = pii.replace(text, b"k")
    assert [f["kind"] for f in found] == ["date", "date", "date", "ssn", "iban", "phone", "card", "email", "ip", "secret"] and len(new) == len(text)
    for f in found:
        a, b = text[f["start"] : f["end"]], new[f["start"] : f["end"]]
        assert a != b and [c.isdigit() for c in a] == [c.isdigit() for c in b]
        assert pii.replace(b, b"k")[1] or f["kind"] == "secret"  # a pseudonym is valid in its format again
    again, _ = pii.replace("4111 1111 1111 1111", b"k")
    assert again.replace(" ", "") == new[found[6]["start"] : found[6]["end"]].replace("-", "")
    for clean in ("4111 1111 1111 1112", "2001-02-30", "999.1.1.1", "000-12-3456", "see page 12 of 2024", "DE88 3704 0044 0532 0130 00"):
        assert pii.replace(clean, b"k") == (clean, [])
    assert pii.replace(text, b"other")[0] != new


def test_pseudonyms_beside_digits_and_capitals():
    card, iban = "4111 1111 1111 1111", "BE68 5390 0754 7034"
    for text, value in ((f"{card} 12/26", card), (f"{card} 123", card), ("4111-1111-1111-1111-12", "4111-1111-1111-1111"), (f"{iban} EUR", iban), (f"{iban} EURO 5", iban)):
        new, found = pii.replace(text, b"k")
        assert [text[f["start"] : f["end"]] for f in found] == [value] and value not in new and len(new) == len(text)
    for day in ("12 March 2020", "March 12, 2020", "3 Sep 1999", "MAY 04 2001"):
        new, found = pii.replace(f"On {day}.", b"k")
        assert [f["kind"] for f in found] == ["date"] and day not in new and len(new) == len(day) + 4 and pii.replace(new, b"k")[1] == found
    assert pii.replace("31 February 2020", b"k") == ("31 February 2020", [])


def test_pseudonyms_of_odd_rows(docs, none):
    out = pii.pseudonymise(docs)
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter((i, t) for i, t, _ in ROWS)
    assert out.where("n_found != 0").count() == 0 and pii.pseudonymise(none).count() == 0
    assert pii.pseudonymise(docs, report=False).columns == docs.columns


def test_pseudonyms_of_odd_values():
    """Very long secrets, other digits, versions; one phone number or date however it is written; time in proportion."""
    for text in ("token=" + "a1" * 150, "token=" + "a1B-" * 20000, "a" * 64 + "@" + "b." * 50 + "example"):
        new, found = pii.replace(text, b"k")
        assert len(found) == 1 and len(new) == len(text) and new != text
    for clean in ("٣٢١-٤٥-٦٧٨٩", "3٢1-45-6789", "٢٠٢٠-٠١-٠٢", "version 1.2.3.4", "v1.2.3.4", "Version: 10.0.19.1", "section 1.2.3.4"):
        assert pii.replace(clean, b"k") == (clean, [])
    digits = lambda x: re.sub("[^0-9]", "", pii.replace(x, b"k")[0])
    assert digits("+353 12345678") == digits("+35312345678") == digits("+353 1234 5678") != "35312345678" and digits("+353 12345678").startswith("353")
    assert digits("+49 30 901820").startswith("49") and digits("+1 (988) 555-2485")[1:] == digits("988-555-2485")
    written = {digits(x) for x in ("2020-03-04", "2020/3/4", "2020.03.04")}
    day = next(x for x in written if len(x) == 8)
    assert written == {day, day[:4] + day[5] + day[7]} and digits("04.03.2020") == day[6:] + day[4:6] + day[:4] == digits("04-03-2020")
    assert digits("03/04/2020") == day[4:] + day[:4] and digits("4 Mar 2020") == day[7] + day[:4] and digits("25/12/2020")[4:] == digits("2020-12-25")[:4]
    days = [d.isoformat() for d in (date.fromordinal(730000 + i) for i in range(2000))]
    assert len({pii.replace(d, b"k")[0] for d in days}) == len(days)
    took = []
    for n in (2000, 16000):
        text, at = " ".join(f"u{i}@mail.example" for i in range(n)), time.process_time()
        assert len(pii.replace(text, b"k")[1]) == n
        took.append(time.process_time() - at)
    assert took[1] < 24 * took[0]


def test_pseudonyms_of_all_documents(spark, sf_dir):
    """The query on the whole table: every value that plain patterns know is replaced, one for one in all documents, the rest stays."""
    plain = {"email": r"[a-z0-9.]+@[a-z0-9.]+\.com", "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.])", "card": r"(?<![0-9])[0-9]{16}(?![0-9])", "phone": r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}", "secret": r"(?<=password=)[0-9a-f]{18}"}
    old = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    known, altered = defaultdict(dict), 0
    rows = queries.QUERIES["op2_pseudonyms"](spark, sf_dir).collect()
    assert len(rows) == len(old)
    for r in rows:
        text = old[r.doc_id] or ""
        assert len(r.text or "") == len(text) and r.n_found == len(r.found)
        kept, at = [], 0
        for f in r.found:
            kept.append(text[at : f.start] == r.text[at : f.start])
            at = f.end
            assert known[f.kind].setdefault(text[f.start : f.end], r.text[f.start : f.end]) == r.text[f.start : f.end] != text[f.start : f.end]
        assert all(kept) and text[at:] == (r.text or "")[at:]
        spans = [(f.start, f.end) for f in r.found]
        for kind, pattern in plain.items():
            for m in re.finditer(pattern, text):
                if kind != "card" or pii.luhn_digit(m[0][:-1]) == m[0][-1]:
                    assert any(a <= m.start() and m.end() <= b for a, b in spans), (kind, m[0])
        altered += bool(r.found) and not any(re.search(p, text) for p in plain.values()) and "token" not in text
    assert all(len(set(x.values())) == len(x) for x in known.values()) and len(known) >= 4
    assert altered <= 0.02 * len(old)
