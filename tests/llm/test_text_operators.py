"""Operators on single texts against the libraries and brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest

from wayfold.llm import language_id, pieces, secret_scans, sentencepiece_codec, substring_dedup, token_counts, toxicity, url_filters

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = ["", "a", " ", "  ", "\n", " \n", "\n\n", "▁", "a▁b", "é 漢\nb", "<s> </s><unk>", "\x00x", "x" * 3000, "the the  the ", "\r\n\t", "🙂🙂"]
#: Clashing names of operators' own columns, next to the real ones.
EXTRA = "doc_id long, text string, key string, fp long, at int, met long, hash long, rows long, lang string, n_chars long"


def texts(n=300, seed=7):
    rng = random.Random(seed)
    parts = ["a", "the", " ", "  ", "\n", "▁", "é", "漢", "<s>", "\t", "🙂", "\r\n", "x1", "…", "word", "Straße", ". "]
    return ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def frame(spark, rows):
    """(doc_id, text) rows with extra columns that have operators' own names."""
    return spark.createDataFrame([(i, t, "k", 1, 2, 3, 4, 5, "en", 6) for i, t in rows], EXTRA)


def test_parts_encode_as_the_library():
    model, count, codec = pieces.load(PIECES), token_counts.counter(PIECES), sentencepiece_codec.codec(PIECES)
    assert model.splits
    for text in texts():
        ids = model.processor.encode(text)
        assert codec.encode(text)[0].tolist() == ids
        assert count(text) == len(ids)
        assert codec.decode(np.array(ids, np.int32)) == model.processor.decode(ids)


def test_spans_are_the_librarys():
    codec = sentencepiece_codec.codec(PIECES)
    for text in texts():
        proto = codec.model.processor.encode_as_proto(text)
        starts, ends = codec.spans(text, codec.encode(text)[0])
        for p, a, b in zip(proto.pieces, starts, ends, strict=True):
            if codec.model.types[p.id] != 6:  # the library gives a character's bytes to its last byte piece
                assert (p.begin, p.end) == (a, b)


def test_longest_prefix_map():
    """A hand-made map: 'a' to 'x', 'ab' to 'yz'; longest first, source spans kept."""
    import struct

    # units of a double array with the keys a and ab
    size = 1024
    units = [0] * size
    base = 256
    units[0] = base << 10
    a_at = 0 ^ base ^ ord("a")
    a_base = 512
    units[a_at] = (((a_base ^ a_at) ^ a_at) ^ a_at) << 10 | 1 << 8 | ord("a")
    after = a_at ^ ((units[a_at] >> 10) << ((units[a_at] & 512) >> 6))
    strings = b"x\0yz\0"
    units[after] = 1 << 31 | 0
    b_at = after ^ ord("b")
    units[b_at] = (768 ^ b_at) << 10 | 1 << 8 | ord("b")
    units[b_at ^ (units[b_at] >> 10)] = 1 << 31 | 2
    blob = struct.pack("<I", size * 4) + struct.pack(f"<{size}I", *units) + strings
    known = sentencepiece_codec.CharacterMap(blob)
    assert known.longest(b"abc", 0) == (2, b"yz") and known.longest(b"ac", 0) == (1, b"x") and known.longest(b"c", 0) is None

    class Spec:
        add_dummy_prefix, remove_extra_whitespaces, escape_whitespaces = False, False, True

    out, starts, ends = sentencepiece_codec.normalise("cabaé", Spec, known)
    assert out == "cyzxé".encode()
    assert starts.tolist() == [0, 1, 1, 3, 4, 4] and ends.tolist() == [1, 3, 3, 4, 6, 6]


def test_token_frames(spark):
    rows = [(1, None), (1, None), (None, "a b"), (2, ""), (3, "word " * 6000)]
    got = sorted(map(tuple, token_counts.count_tokens(frame(spark, rows), PIECES).collect()), key=repr)
    n = len(pieces.load(PIECES).processor.encode("word " * 6000))
    assert got == sorted([(1, 0, 0, False), (1, 0, 0, False), (None, 3, 2, False), (2, 0, 0, False), (3, 30000, n, True)], key=repr)
    assert token_counts.count_tokens(frame(spark, []), PIECES).collect() == []
    coded = {r.doc_id: r for r in sentencepiece_codec.encode_documents(frame(spark, rows[1:]), PIECES, spans_out=True).collect()}
    assert coded[2].ids == [] and coded[2].decoded == "" and coded[3].decoded == "word " * 6000
    assert coded[1].ids_sha256 == hashlib.sha256(b"").hexdigest()


def test_json_vocabulary(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    assert all(token_counts.counter(path)(t) == len(own.encode(t, add_special_tokens=False).ids) for t in texts(50))


def _brute_secrets(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_secrets():
    rng, encoding = random.Random(3), secret_scans.vocabulary(BYTES)
    pool = ["token", "Secret", "api_key", "apikey", "PASSWD", "=", ":", " ", "'", '"', "abc123", "AKIA", "ABCD1234ABCD1234", "0123456789abcdef" * 2, "é", "\n", "x", "deadbeef"]
    for _ in range(1500):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))
        assert [s for s in secret_scans.scan(text, encoding) if s[1] < 3] == _brute_secrets(text)


def test_random_strings():
    encoding = secret_scans.vocabulary(BYTES)
    rng = random.Random(5)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = ["".join(rng.choice(alphabet) for _ in range(40)) for _ in range(200)]
    assert sum(secret_scans.is_random(k, encoding) for k in keys) >= 195
    clean = ["a" * 64, "0f" * 32, "123e4567-e89b-12d3-a456-426614174000", "internationalization_of_names", "SomeVeryLongCamelCaseIdentifier", "MAX_NUMBER_OF_RETRIES_2024", "1234567890123456789012"]
    assert not any(secret_scans.is_random(c, encoding) for c in clean)


def test_random_strings_of_small_alphabets_and_after_readable_text():
    encoding = secret_scans.vocabulary(BYTES)
    rng = random.Random(6)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    for alphabet in (lower + digits, lower + "234567", lower, upper, lower + upper + digits, lower + upper + digits + "+/"):
        for before in ("", "client_credential=", "internal/services/payments/callback/signature/"):
            for after in ("", "/internal/services/payments/callback/x9"):
                keys = ["".join(rng.choice(alphabet) for _ in range(32)) for _ in range(100)]
                assert sum(secret_scans.is_random(before + k + after, encoding) for k in keys) >= 95
    key = "q7Zk2mX9vB4tR8nL1pW6sD3fG5hJ0cYa"
    text = f"see internal/services/payments/{key} or client_credential={key}"
    assert [text[a:b] for a, k, b in secret_scans.scan(text, encoding) if k == 3] == [key, key]
    clean = ["internal/services/payments/callback/signature", "src/main/java/com/example/service/PaymentCallbackHandler", "https/api/2024/05/03/monthly-report-summary", "users/123e4567-e89b-12d3-a456-426614174000", "CO_FUTURE_NUMBER_AS_DEFAULT"]
    assert not any(secret_scans.is_random(c, encoding) for c in clean)


def test_redaction(spark):
    rows = [(1, "my token = abcdef123 and more"), (1, "my token = abcdef123 and more"), (2, None), (3, "clean"), (None, "")]
    got = sorted([(r.doc_id, r.text, r.n_chars, r.key) for r in secret_scans.redact_documents(frame(spark, rows), BYTES).collect()], key=repr)
    assert got == sorted([(1, "my [REDACTED] and more", 22, "k")] * 2 + [(2, None, 6, "k"), (3, "clean", 6, "k"), (None, "", 6, "k")], key=repr)


@pytest.mark.parametrize(
    ("url", "wanted"),
    [
        (None, ("", "", None, "allow")),
        ("no scheme", ("", "", None, "allow")),
        ("http://WWW.Example.COM/en/1?x", ("www.example.com", "/en/1", "www.example.com/en/", "allow")),
        ("http://m.example.com/en/1", ("m.example.com", "/en/1", "example.com/en/", "block")),
        ("http://example.com", ("example.com", "", None, "allow")),
        ("http://a.net/es/#top", ("a.net", "/es/", "net/es/", "block")),
        ("http://notexample.com/x", ("notexample.com", "/x", "com/", "allow")),
        ("https://www.casino-win.example.org/en/14", ("www.casino-win.example.org", "/en/14", None, "block")),
        ("a://b://c/d", ("b:", "//c/d", None, "allow")),
    ],
)
def test_urls(url, wanted):
    assert url_filters.Filter(url_filters.HOST_RULES, url_filters.PATTERN_RULES).judge(url) == wanted


def test_url_index_finds_what_all_rules_find():
    rng = random.Random(9)
    own = url_filters.Filter((), url_filters.PATTERN_RULES)
    words = ["casino", "cheap-pills", "free-bets", "spam-farm", "ads-track", "utm_source=feed", "example", "org", "de", "www"]
    for _ in range(2000):
        url = "http://" + ".".join(rng.choice(words) for _ in range(3)) + "/" + rng.choice(["de/12", "en/3", ""]) + rng.choice(["", "?utm_source=feed", "#x"])
        hit = {v for v, e in url_filters.PATTERN_RULES if re.search(e, url)}
        assert (own.pattern_verdict(url) or "allow") == ("allow" if "allow" in hit or "block" not in hit else "block")


@pytest.mark.parametrize(
    ("expression", "wanted"),
    [
        (r"://([^/?#]*[.-])?casino[.-]", ("casino",)),
        (r"\.org/de/[0-9]+([./?#]|$)", ("org", "de")),
        (r"[?&]utm_source=feed(&|#|$)", ("utm", "source", "feed")),
        (r"casino", ()),  # it may be a piece of a longer token
        (r"/free[a-z]?bets/", ()),
        (r"/(a|b)c/", ()),
        (r"/(ads)?/x/", ("x",)),
        (r"^pills\.", ("pills",)),
        (r"-pills$", ("pills",)),
        (r"/x*y/", ()),
        (r"[^/]bad/", ()),
    ],
)
def test_tokens_stand_by_themselves_in_every_match(expression, wanted):
    assert url_filters.tokens_of(expression) == wanted


def test_url_frames_in_parts_of_the_rules(spark):
    urls = ["http://www.example.com/en/1", "http://a.net/es/", "http://casino.org/x", "http://casino.example.org/de/1", None, "", "no scheme", "http://a.com", "x" * 50_000, "HTTP://Free-Bets.NET/fr/2"]
    pages = spark.createDataFrame([(n, u, "h", "p", "r") for n, u in enumerate(urls)] + [(None, urls[0], "h", "p", "r")] * 2, "page_id long, url string, host string, path string, rule string")
    whole = url_filters.Filter(url_filters.HOST_RULES, url_filters.PATTERN_RULES)
    wanted = sorted([(n, *whole.judge(u)) for n, u in enumerate(urls)] + [(None, *whole.judge(urls[0]))] * 2, key=repr)
    hosts = spark.createDataFrame(list(url_filters.HOST_RULES), "verdict string, host string, path string")
    patterns = spark.createDataFrame(list(url_filters.PATTERN_RULES), "verdict string, expression string")
    for most in (1, 3, 100):
        rules = url_filters.read_rules(hosts, patterns, most)
        assert sorted(map(tuple, url_filters.judge_pages(pages, rules).collect()), key=repr) == wanted
    assert url_filters.judge_pages(pages.where("false"), whole).collect() == []
    free = url_filters.judge_pages(pages, url_filters.read_rules(hosts.where("false"), patterns.where("false"))).collect()
    assert {r.verdict for r in free} == {"allow"}


def test_secret_frames(spark):
    encoding = secret_scans.vocabulary(BYTES)
    key = "q7Zk2mX9vB4tR8nL1pW6sD3fG5hJ0cYa"
    texts_ = ["token = abcdef123", f"é {key} AKIA{'B' * 16}", "clean words only", "", None, ("word " * 30_000) + key, "0123456789abcdef" * 3]
    rows = [(n, t) for n, t in enumerate(texts_)] + [(None, texts_[0]), (0, texts_[0])]
    got = secret_scans.scan_documents(frame(spark, rows), BYTES).collect()
    assert len(got) == len(rows)
    for r in got:
        found = secret_scans.scan(texts_[r.doc_id or 0] or "", encoding)
        assert [r.n_assign, r.n_access, r.n_hex, r.n_random] == [sum(k == kind for _, k, _ in found) for kind in range(4)]
        base = _brute_secrets(texts_[r.doc_id or 0] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(f"{secret_scans.KINDS[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
        assert r.spans == ",".join(f"{secret_scans.KINDS[k]}:{a}:{b}" for a, k, b in found)
    assert [r.n_random for r in got if r.doc_id == 5] == [1] and secret_scans.scan_documents(frame(spark, []), BYTES).collect() == []


def test_languages(spark):
    rng = random.Random(1)
    stems = {"en": "the of and that thing over".split(), "de": "der die und nicht schön über".split(), "fr": "le été où français très".split()}
    rows = [(n, " ".join(rng.choice(stems[lang]) for _ in range(40)), lang) for n, lang in enumerate(["en", "de", "fr"] * 60)]
    rows += [(900, None, "en"), (901, "123 --- 456", None), (901, "", "de"), (None, "der die und", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "'x' AS key")
    got = language_id.identify(docs).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out and r.doc_id < 900]
    truth = {n: lang for n, _, lang in rows}
    assert held and all(r.lang_pred == truth[r.doc_id] for r in held) and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (900, 901)} == {"und"}
    kept = language_id.keep_known(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    assert {r.lang_pred for r in language_id.identify(docs.where("false")).collect()} == set()
    assert {r.lang_pred for r in language_id.identify(docs.withColumn("lang", docs["lang"].substr(100, 1)).where("doc_id = 2").drop("lang").selectExpr("*", "CAST(null AS string) AS lang")).collect()} == {"und"}


def test_unlearned_languages_are_rejected():
    rng = random.Random(4)
    words = {
        "en": "the of and that thing over water house people other would their about which there when make time year work good from have this with".split(),
        "de": "der die und nicht schön über wasser haus menschen andere würde ihre welche dort wenn machen zeit jahr arbeit gut von haben diese mit".split(),
        "fr": "le été où français très eau maison gens autre serait leur quelle dont quand faire temps année travail bon avoir cette avec pour dans".split(),
    }
    rows = [(lang, " ".join(rng.choice(own) for _ in range(rng.choice((3, 8, 30, 200))))) for lang, own in words.items() for _ in range(150)]
    rows += [(lang, "zq xj kv") for lang in words]  # a noisy labelled text moves no bound
    model = language_id.fit(rows)
    finnish = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto"
    polish = "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem"
    letters = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(100))
    assert all(model.predict(t)[2] for t in (finnish, finnish[:60], polish, polish[:60], letters, letters[:60], finnish * 40))
    clean = [(lang, " ".join(rng.choice(own) for _ in range(n))) for lang, own in words.items() for n in (2, 4, 10, 40, 300) for _ in range(40)]
    assert not any(model.predict(t)[2] for _, t in clean)


def test_toxicity_learns_misspellings(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    bad = ["worthless", "pathetic", "disgusting"]

    def text(toxic):
        return " ".join(rng.choice(words) if rng.random() > 0.1 * toxic else rng.choice(bad) for _ in range(80))

    rows = [(n, text(n % 2), n % 2) for n in range(600)]
    docs = spark.createDataFrame([(n, t) for n, t, _ in rows] + [(5000, None), (5000, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(n, 1, y) for n, _, y in rows] + [(7, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score_documents(docs, model).collect()
    truth = {n: y for n, _, y in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got) and [r.predicted for r in got if r.doc_id == 5000] == [0, 0]
    scorer = toxicity.Scorer(*model)
    plain = " ".join(words[:60])
    assert scorer.score(plain + " worthles disgustin pathetc w0rthless" * 2) > scorer.score(plain) + 0.2
    nothing = toxicity.train(docs, labels.where("false"))
    assert {r.score for r in toxicity.score_documents(docs, nothing).collect()} == {0.0}
    assert toxicity.score_documents(docs.where("false"), model).collect() == []


def _prose(rng, n):
    return " ".join((" ".join(rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) for _ in range(rng.randint(3, 9))) + ".").capitalize() for _ in range(n))


def test_substring_dedup(spark):
    rng = random.Random(4)
    passage = _prose(rng, 12)
    words = len(passage.split())
    assert words > 50
    rows = [(n, _prose(rng, 6) + " " + (passage + " " if n % 3 == 0 else "") + _prose(rng, 6)) for n in range(30)]
    long_line = " ".join("".join(rng.choice("abcdef") for _ in range(4)) for _ in range(90))
    rows += [(100, "One two three " + long_line), (101, "Other start here now " + long_line), (102, None), (103, ""), (104, "of " * 80), (105, "And of " + "of " * 80), (None, passage)]
    got = {r.doc_id: r for r in substring_dedup.deduplicate(frame(spark, rows)).collect()}
    before = dict(rows)
    assert got[0].text == before[0] and got[100].text == before[100] and got[102].text is None and got[103].text == ""
    for n in range(1, 30):
        if n % 3:
            assert got[n].text == before[n] and got[n].n_removed == 0
        else:
            assert got[n].n_removed >= 8 and len(got[n].text.split()) < len(before[n].split()) - words + 30
    assert len(got[101].text.split()) < 60 and len(got[105].text.split()) < 50
    assert got[None].n_removed >= 8  # an id before it has the passage
    assert substring_dedup.deduplicate(frame(spark, [])).collect() == []
    same = [r.text for r in substring_dedup.deduplicate(frame(spark, [(1, passage), (1, passage)])).collect()]
    assert same == [passage, passage]


def brute_substrings(rows):
    """What substring deduplication keeps, by plain loops over all spans of all documents."""
    seen, out = {}, {}
    order = sorted(range(len(rows)), key=lambda n: (rows[n][0] is None, rows[n][0] or 0, 0 if rows[n][0] is not None else rows[n][2]))
    said = {n: substring_dedup.spoken(rows[n][1] or "") for n in order}
    whose = lambda n: rows[n][0] if rows[n][0] is not None else ("null", rows[n][2])

    def runs(n):
        for at in range(len(said[n])):
            for end in range(at + 1, len(said[n]) + 1):
                if end - at >= substring_dedup.SENTENCES and sum(k for _, k in said[n][at:end]) >= substring_dedup.WORDS:
                    yield at, end, " ".join(w for w, _ in said[n][at:end])
                    break

    for n in order:
        for _, _, words in runs(n):
            seen.setdefault(words, whose(n))
    for n in order:
        gone, own = set(), set()
        for at, end, words in runs(n):
            if seen[words] != whose(n) or words in own:
                gone |= set(range(at, end))
            own.add(words)
        out[n] = len(gone)
    return [out[n] for n in range(len(rows))]


def test_substring_dedup_is_the_brute_force_one(spark):
    from pyspark.sql import functions as F

    rng = random.Random(8)
    sentences = [_prose(rng, 1) for _ in range(40)]
    texts = [" ".join(rng.choice(sentences) for _ in range(rng.randint(0, 14))) for _ in range(60)]
    block = " ".join(sentences[:9])
    texts += [block, block + " " + block, "Then home.", "Then home.", "", None, "x. " * 50]
    last = (1 << 63) - 1
    ids = [rng.choice([None, *range(50), last]) for _ in texts]
    docs = frame(spark, list(zip(ids, texts, strict=True)))
    ties = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    rows = [(i, t, ties[t]) for i, t in zip(ids, texts, strict=True)]
    got = sorted([(r.doc_id, r.n_removed) for r in substring_dedup.deduplicate(docs).collect()], key=repr)
    wanted = sorted(zip(ids, brute_substrings(rows), strict=True), key=repr)
    assert got == wanted and sum(n for _, n in wanted) > 50


def test_substring_dedup_of_documents_without_an_id(spark, tmp_path):
    import os

    rng = random.Random(9)
    passage = _prose(rng, 12)
    rows = [(None, _prose(rng, 4) + " " + passage) for _ in range(6)] + [(None, passage)] * 2 + [((1 << 63) - 1, _prose(rng, 4))]
    got = substring_dedup.deduplicate(frame(spark, rows)).collect()
    assert len(got) == len(rows) and sorted({r.doc_id is None for r in got}) == [False, True]
    assert sum(passage in r.text for r in got) in (1, 2)  # one owner; equal texts without an id are one document
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert not [f for f in os.listdir(folder) if f.startswith("spans-")]
    shorter = substring_dedup.deduplicate(frame(spark, [(1, "Then home. Now."), (2, "Then home. Now.")]), sentences=1, least_words=2).collect()
    assert sorted((r.doc_id, r.text) for r in shorter) == [(1, "Then home. Now."), (2, " Now.")]
