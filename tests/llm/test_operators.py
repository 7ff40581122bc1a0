import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from brute import components, contamination, cosine, digest, fingerprint, pii_spans, secret_spans
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from roadlens.llm import components as cc
from roadlens.llm import decontaminate, langid, packing, pii, quality, secrets, simhash, substrings, vectors, warc
from roadlens.llm.common import fresh_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def documents(spark, texts, langs=None):
    rows = [(i, t, (langs or [None] * len(texts))[i], None, None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


# 1


def test_language_id_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    found = [r for r in langid.op1(docs).collect() if r["held_out"]]
    assert {r["doc_id"] for r in found} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in found) / len(found) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_id_is_the_plain_one(spark, docs, texts):
    """Whole texts, compressed block by block with each language's content; the fewest bytes win."""
    learned = langid.learn(langid.training_rows(docs))
    bare = zstandard.ZstdCompressionParameters.from_level(langid.LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0)
    books = {lang: zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for lang, content in learned.items()}
    by_doc = {r["doc_id"]: r for r in langid.op1(docs).collect()}
    for i, text in list(texts.items())[:60]:
        letters = " " + re.sub(r"[\W\d_]+", " ", (text or "").lower())
        if not any(map(str.isalpha, text or "")):
            assert by_doc[i]["lang_pred"] == "und"
            continue
        data = letters.encode()
        sizes = {}
        for lang, book in books.items():
            empty = len(zstandard.ZstdCompressor(compression_params=bare, dict_data=book).compress(b""))
            sizes[lang] = sum(len(zstandard.ZstdCompressor(compression_params=bare, dict_data=book).compress(data[k : k + 4096])) - empty for k in range(0, len(data), 4096))
        least = min(sizes.values())
        if sorted(sizes.values())[1] > least:
            assert by_doc[i]["lang_pred"] == min(sizes, key=sizes.get)


def test_language_id_is_undecided_without_letters(spark):
    rows = documents(spark, [None, "12 34!", "ab"])
    assert [r["lang_pred"] for r in langid.identify(rows, {"xx": b"ab cd", "yy": b"ef gh"}).orderBy("doc_id").collect()] == ["und", "und", "xx"]


def test_language_sample_is_of_distinct_texts(spark):
    rows = spark.sql("select if(id < 40000, 'copied text', concat('word', id, ' x')) text, if(id < 40000 or id % 2 = 0, 'aa', 'bb') lang from range(40400)")
    learned = langid.learn(rows, rows=20)
    assert langid.learn(rows.limit(0)) == {} and len(langid.learn(rows, rows=20, letters=1)["bb"].split()) == 2
    assert list(learned) == ["aa", "bb"]
    assert [len(c.split(b" word")) - 1 + (b"copied" in c) for c in learned.values()] == [20, 20]
    # Copies change no language's sample, and so doesn't the number of rows.
    assert learned == langid.learn(rows.distinct().unionByName(rows.filter("text = 'copied text'").limit(2)), rows=20)
    assert len(langid.learn(rows, rows=500)["aa"].split(b" word")) - 1 == 200


# 4 and 9


def check_pii(text):
    found = pii.find_spans(text, pii._automaton())
    assert [(k, a, b) for k in pii.BASE for a, b in found[k]] == pii_spans(text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1@.+-% ()éx25", max_size=40))
def test_personal_data_base_is_that_of_the_expressions(text):
    check_pii(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["4111111111111111", "+49 30 123456", "1.2.3.4", "256.1.1.1", "a@b.c", ".", "-", " ", "@", "+", "0", "x"]), max_size=12))
def test_personal_data_base_on_parts(parts):
    check_pii("".join(parts))


def test_personal_data_over_documents(spark, docs, texts):
    for r in pii.op4(docs).collect():
        spans = pii_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == digest(spans)
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in spans) for k in pii.BASE]


def test_personal_data_adds_accounts_and_logins(spark):
    text = "IBAN: DE89 3704 0044 0532 0130 00 and account 12345678 via ftp://me:pw@host.org"
    spans = pii.find_spans(text, pii._automaton())
    cut = {k: [text[a:b] for a, b in v] for k, v in spans.items()}
    assert cut["iban"] == ["DE89 3704 0044 0532 0130 00"] and cut["account"] == ["12345678"] and cut["login"] == ["me:pw"]
    masked = pii.mask_personal_data(documents(spark, ["write a.b@c.org now", None])).orderBy("doc_id").collect()
    assert masked[0]["text"] == "write [EMAIL] now" and masked[0]["n_chars"] == len(masked[0]["text"]) and masked[1]["text"] is None


def plain_added(text):
    """Logins by an expression; accounts and IBANs by reading on from each cue."""
    login = [m.span(1) for m in re.finditer(r"(?=://([A-Za-z0-9._~%!$&'()*+,;=:-]*)@)", text) if ":" in m[1]]
    found = []
    for m in re.finditer("|".join(f"{c}|{c.capitalize()}|{c.upper()}" for c in pii.CUES), text):
        rest = re.match(r"(?:(?![0-9]|[A-Z].[0-9][0-9])[^\n@]){0,11}(?=[0-9]|[A-Z].[0-9][0-9])", text[m.end() :], re.S)
        if rest:
            start = m.end() + rest.end()
            body = re.match(r"[0-9A-Z](?:[ -]?[0-9A-Z])*", text[start:])[0]
            token = re.sub("[ -]", "", body)
            number = "".join(str(int(c, 36)) for c in token[4:] + token[:4])
            if re.fullmatch(r"[A-Z]{2}[0-9]{2}[0-9A-Z]{11,30}", token) and int(number) % 97 == 1:
                found.append(("iban", start, start + len(body)))
            elif 6 <= sum(c.isdigit() for c in token) <= 20:
                found.append(("account", start, start + len(body)))
    return login, found


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["IBAN", "account", "SSN", " ", ": ", "no. ", "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "12345678", "12-34-56", "99", "x", "\n", "A"]), max_size=7))
def test_accounts_are_those_of_the_plain_reading(parts):
    text = "".join(parts)
    spans = pii.find_spans(text, pii._automaton())
    expected, low = [], 0
    for kind, a, b in plain_added(text)[1]:
        if a >= low:  # a cue within what was found before is none
            expected.append((kind, a, b))
            low = b
    got = sorted((k, *s) for k in ("account", "iban") for s in spans[k])
    assert set(got) <= set(plain_added(text)[1]) and (sorted(expected) == got or len(got) >= 1)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["http", "://", "me", ":", "pw", "@", "host.org", "/", " ", "a%20b"]), max_size=9))
def test_logins_are_those_of_the_expression(parts):
    text = "".join(parts)
    got = pii.find_spans(text, pii._automaton())["login"]
    plain = plain_added(text)[0]
    assert set(got) <= set(plain) and bool(got) == bool(plain)


def test_no_spans_are_added_to_plain_documents(spark, docs, texts):
    """What is added on the test tables are spans that the plain reading finds too."""
    for r in pii.op4(docs).collect():
        text = texts[r["doc_id"]] or ""
        login, found = plain_added(text)
        plain = {f"login:{a}:{b}" for a, b in login} | {f"{k}:{a}:{b}" for k, a, b in found}
        added = {s for s in r["spans"].split(",") if s.split(":")[0] in ("account", "iban", "login")}
        assert added <= plain and bool(added) == bool(plain)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "PassWd", "api_key", "APIKEY", "toKen", "token", "=", ":", " ", '"', "abcdef", "AKIA", "ABCDEFGH12345678", "0123456789abcdef01234567", "a", "ſecret"]), max_size=10))
def test_secret_base_is_that_of_the_expressions(parts):
    text = "".join(parts)
    assert [(secrets.KINDS[k], a, b) for a, k, b in secrets.base_spans(text)] == secret_spans(text)


def test_secrets_over_documents(spark, docs, texts):
    rows = secrets.op9(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = secret_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == digest(spans)
        listed = r["spans"].split(",")
        assert all(f"{k}:{a}:{b}" in listed for k, a, b in spans)


DIGITS, SMALL, CAPITALS = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def pick(dice, chars, n):
    return "".join(dice.choice(chars) for _ in range(n))


def wordy(dice):
    return pick(dice, "etaoinshrdlucm", dice.randint(3, 12))


FORMATS = {
    "hex": lambda d: pick(d, "0123456789abcdef", 40),
    "key": lambda d: "ghp_" + pick(d, DIGITS + SMALL + CAPITALS, 36),
    "any length": lambda d: pick(d, DIGITS + SMALL + CAPITALS, d.randint(12, 24)),
    "word and number": lambda d: pick(d, SMALL, d.randint(4, 7)) + pick(d, DIGITS, d.randint(3, 4)),
}


@pytest.fixture(scope="module")
def secret_model():
    dice = random.Random(3)
    ordinary = sorted({wordy(dice) for _ in range(2000)} | {f"{wordy(dice)}-{wordy(dice)}/{wordy(dice)}" for _ in range(500)} | {pick(dice, DIGITS, 16) for _ in range(60)})
    return secrets.Model({name: [make(dice) for _ in range(500)] for name, make in FORMATS.items()}, ordinary)


def test_inferred_automata_tell_formats_from_words(secret_model):
    dice = random.Random(8)
    states = {name: len(a.steps) for name, a, _ in secret_model.formats}
    assert states["hex"] == 41 and states["key"] <= 60 and states["any length"] <= 60 and states["word and number"] <= 30
    for name, make in FORMATS.items():
        values = [make(dice) for _ in range(300)]
        assert sum(secret_model.search(v) == [(0, len(v))] for v in values) >= 0.9 * len(values), name
    clean = [wordy(dice) for _ in range(3000)] + [f"{wordy(dice)}/{wordy(dice)}_{wordy(dice)}" for _ in range(1000)] + [pick(dice, DIGITS, 16) for _ in range(300)]
    assert sum(bool(secret_model.search(v)) for v in clean) <= 3


def test_length_is_part_of_a_format(secret_model):
    dice = random.Random(4)
    automaton = next(a for name, a, _ in secret_model.formats if name == "hex")
    value = FORMATS["hex"](dice)
    assert secret_model.gain(automaton, value) > 100
    assert secret_model.gain(automaton, value[:-1]) == secret_model.gain(automaton, value + "a") == -np.inf


def test_states_that_differ_are_not_merged():
    """Two formats of one set of classes: either four digits or nine, never what lies between."""
    dice = random.Random(1)
    automaton = secrets.Automaton([pick(dice, DIGITS, dice.choice((4, 9))) for _ in range(400)])
    assert [n for n in range(1, 14) if automaton.parts("1" * n, 0, [n])] == [4, 9]
    # The probabilities of all that it writes add up to one.
    assert sum(10**n * np.mean(np.exp([automaton.parts(pick(dice, DIGITS, n), 0, [n])[0][1] for _ in range(4000)])) for n in (4, 9)) == pytest.approx(1, abs=0.1)


def plain_search(model, token):
    """Every part between separators, one by one."""
    starts = [i for i in range(len(token)) if i == 0 or token[i - 1] in "+/_.=-"]
    ends = [i for i in range(1, len(token) + 1) if i == len(token) or token[i] in "+/_.=-"]
    out, low = [], 0
    for a in starts:
        held = [b for b in ends if b - a >= 6 and any(model.gain(f, token[a:b]) >= least for _, f, least in model.formats)]
        if held and a >= low:
            low = max(held)
            out.append((a, low))
    return out


def test_search_is_the_plain_one(secret_model):
    dice = random.Random(6)
    for _ in range(1500):
        parts = [dice.choice([wordy, *FORMATS.values(), lambda d: ""])(dice) for _ in range(dice.randint(1, 5))]
        token = "".join(p + dice.choice("+/_.=-") for p in parts)[: dice.choice((None, -1))]
        assert secret_model.search(token) == plain_search(secret_model, token)


def test_credentials_behind_long_paths_are_found(secret_model):
    dice = random.Random(8)
    found = 0
    for _ in range(100):
        path, key = "/".join(wordy(dice) for _ in range(20)), FORMATS["key"](dice)
        text = f"see {path}/{key}=x."
        base, spans = secrets.all_spans(text, secret_model)
        found += [text[a:b] for a, _, b in spans] == [key]
        assert not base
        assert not secrets.all_spans(f"see {path}/a1", secret_model)[1]
    assert found >= 90


def test_unlabelled_credentials_of_a_labelled_format_are_found(spark):
    """One of three credentials stands behind a cue; the others are planted in prose, half of them in paths."""
    dice = random.Random(21)
    rows, planted = [], {}
    for i in range(900):
        words_ = [wordy(dice) for _ in range(60)]
        if i % 3 == 0:
            words_[30] = f'token = "{FORMATS["key"](dice)}"'
        elif i % 3 == 1:
            planted[i] = FORMATS["key"](dice)
            words_[30] = planted[i] if i % 2 else f"{wordy(dice)}/{planted[i]}/{wordy(dice)}"
        rows.append(" ".join(words_))
    docs = documents(spark, rows)
    model = secrets.learn(docs)
    assert len(model.formats) == 1
    got = {r["doc_id"]: [s.split(":") for s in r["spans"].split(",") if s.startswith("format")] for r in secrets.secrets(docs, model).collect()}
    cut = {i: [rows[i][int(a) : int(b)] for _, a, b in found] for i, found in got.items()}
    assert sum(cut[i] == [k] for i, k in planted.items()) >= 0.9 * len(planted)
    assert not any(cut[i] for i in cut if i not in planted)
    masked = {r["doc_id"]: r["text"] for r in secrets.mask_secrets(docs, model).collect()}
    assert sum(planted[i] not in masked[i] for i in planted) >= 0.9 * len(planted)


def test_rare_credentials_are_learned(spark):
    rows = spark.sql("select concat('plain words number-', id, if(id % 100 = 0, concat(' AKIA', upper(substring(sha1(string(id)), 1, 16))), '')) text from range(3000)")
    assert [name for name, _, _ in secrets.learn(rows, sample_docs=20).formats] == ["access Ud"]


# 5


def test_fingerprints_and_components(spark, docs, texts):
    prints = {i: fingerprint(t) for i, t in texts.items()}
    expected = components(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op5(docs).collect()}
    assert got == {i: (f"{prints[i]:016x}", expected[i]) for i in texts}


def test_texts_that_share_an_id_are_kept_by_component(spark):
    dice = random.Random(6)
    a, b, c = (" ".join(str(dice.random()) for _ in range(60)) for _ in range(3))
    rows = spark.createDataFrame([(0, a, None, None, 1), (5, a, None, None, 1), (5, b, None, None, 1), (5, c, None, None, 1), (5, c, None, None, 1), (7, b, None, None, 1)], DOCS)
    assert sorted((r["doc_id"], r["text"]) for r in simhash.keep_one(rows).collect()) == sorted([(0, a), (5, b), (5, c)])


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB \t\n\x0b É", max_size=60))
def test_fingerprint_is_the_plain_one(text):
    assert simhash.fingerprint(text.encode(), 4) == fingerprint(text)


@pytest.mark.parametrize("chunk", [8192, 5])
def test_index_finds_every_component(spark, chunk):
    """With small chunks, large groups are searched by pairs of chunks."""
    dice = random.Random(5)
    codes = set()
    for _ in range(12):
        base = dice.getrandbits(64)
        for _ in range(25):
            code = base
            for _ in range(dice.randint(0, 6)):
                code ^= 1 << dice.randrange(64)
            codes.add(code)
    codes |= {dice.getrandbits(64) for _ in range(100)} | {0, 1, (1 << 64) - 1}
    expected = components(codes, lambda a, b: (a ^ b).bit_count() <= 4)
    signed = lambda c: c - (1 << 64) * (c >> 63)
    frame = spark.createDataFrame([(signed(c),) for c in codes], "code long")
    found = {r["node"]: r["component"] for r in cc.components(simhash.links(frame, 4, chunk)).collect()}
    groups = {}
    for c in codes:
        groups.setdefault(expected[c], set()).add(found.get(signed(c), signed(c)))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_every_link_comes_from_the_index(spark, monkeypatch):
    """Without what a search of the index finds there is no link: no other path compares codes."""
    dice = np.random.default_rng(3)
    codes = dice.integers(0, 2**63, 400, dtype=np.uint64)
    codes = np.concatenate([codes, codes ^ np.uint64(1 << 17)])
    key = (codes >> np.uint64(60)).astype(np.int64)
    rows = simhash.Rows(key, codes, codes.view(np.int64), np.empty((len(codes), 0), np.uint64))
    found = simhash.Forest()
    simhash.search(rows, 4, 0, found)
    assert len(found.links) == 400
    monkeypatch.setattr(simhash.GrayIndex, "search", lambda *a: (np.empty(0, np.int64), np.empty(0, np.int64)))
    none = simhash.Forest()
    simhash.search(rows, 4, 0, none)
    assert not none.links


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2**64 - 1), st.integers(0, 6)), max_size=60), st.integers(0, 4))
def test_the_index_finds_all_pairs_of_a_group(rows, limit):
    codes = []
    for group, code, flips in rows:
        codes += [(group, code), (group, code ^ ((1 << flips) - 1) << 9)]
    index = simhash.GrayIndex(np.array([c for _, c in codes], np.uint64), np.array([g for g, _ in codes], np.int64))
    if not codes:
        return
    got = sorted(zip(*(x.tolist() for x in index.search(index.codes, index.root, limit)), strict=True))
    held = [codes[i] for i in index.order]
    n = range(len(held))
    assert got == [(i, j) for i in n for j in n if held[i][0] == held[j][0] and (held[i][1] ^ held[j][1]).bit_count() <= limit]


def test_near_copies_by_words_and_shingles(spark):
    dice = random.Random(15)
    rows = []
    for i in range(30):
        words_ = [wordy(dice) for _ in range(300)]
        rows.append(" ".join(words_))
        for n in (0, 2, 5, 100):  # words that are replaced in a copy
            other = list(words_)
            for at in dice.sample(range(300), n):
                other[at] = wordy(dice)
            rows.append(" ".join(other))
    docs = documents(spark, rows)
    prints = [simhash.copy_prints(t.encode()) for t in rows]
    linked = lambda a, b: (prints[a][0] ^ prints[b][0]).bit_count() <= 4 and sum((x ^ y).bit_count() for x, y in zip(prints[a][1:], prints[b][1:], strict=True)) <= 25
    comp = components(range(len(rows)), linked)
    kept = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    assert kept == {i for i, c in comp.items() if i == c}
    shingles = [set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for t in rows]
    alike = lambda i, j: len(shingles[i] & shingles[j]) / len(shingles[i] | shingles[j])
    near = [i for i in range(len(rows)) if any(alike(i, j) >= 0.8 for j in range(i // 5 * 5, i))]
    assert len(near) >= 80 and sum(i not in kept for i in near) >= 0.9 * len(near)
    assert all(i in kept for i in range(0, len(rows), 5)) and all(i in kept for i in range(4, len(rows), 5))


def test_rows_without_an_id_and_repeated_rows_in_keep_one(spark):
    rows = spark.createDataFrame(
        [(None, "a b", "en", "s", 3), (None, "a b", "en", "s", 3), (4, "x y z", None, None, 5), (4, "x y z", "en", None, 5), (5, None, None, None, None), (6, "", None, None, 0), (7, "q", None, None, 1)], DOCS
    )
    got = sorted((r["doc_id"] or -1, r["text"]) for r in simhash.keep_one(rows).collect())
    assert got == [(-1, "a b"), (-1, "a b"), (4, "x y z"), (5, None), (7, "q")]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (140, 139), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in cc.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 141)}, 200: 200, 201: 200}
    assert cc.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 6


def test_decontamination_is_the_plain_one(spark, docs, texts):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = [(r["item_id"], r["text"]) for r in bench.collect()]
    rows += [(900, "The and"), (901, ""), (902, None)]
    frame = spark.createDataFrame(rows, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.op6(docs, frame).collect()}
    shuffled = {r["doc_id"]: r for r in decontaminate.contamination(docs, frame, carry=["doc_id"], broadcast_windows=0).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        n, hit, items = contamination(t, rows)
        g = got[i]
        assert (g["n_words"], g["n_hit"], g["n_items"], g["contaminated"]) == (n, len(hit), len(items), bool(hit))
        assert g["items_sha256"] == hashlib.sha256(",".join(items).encode()).hexdigest()
        assert set(shuffled[i]["hit_words"]) == hit


@pytest.mark.parametrize("n", [15, 16, 40])
def test_decontamination_with_wide_windows(spark, n):
    words_ = [f"w{i}" for i in range(90)]
    texts_ = [" ".join(words_[:60]), " ".join(["x"] * 5 + words_[10:55] + ["y"]), "w1 w2 z", " ".join(words_[70:88])]
    bench = [(1, " ".join(words_[5:58])), (2, " ".join(words_[70:88])), (3, "w1 w2")]
    got = decontaminate.contamination(documents(spark, texts_), spark.createDataFrame(bench, "item_id long, text string"), n=n).collect()
    for r in got:
        assert (r["n_words"], set(r["hit_words"]), r["item_ids"]) == contamination(r["text"], bench, n)


# 7


def test_ids_are_those_of_the_tokenizer(texts):
    path, ranks = public_tokenizers.path(packing.TOKENIZER), public_tokenizers.path(packing.RANKS)
    plain = Tokenizer.from_file(path)
    odd = ["", " ", "\n\n  x", "a" * 3000, "é\U0001f600 don't I'LL 12 3", "\t \r\n" * 50, "don't stop now", " " * 1_200_000]
    odd += ["<|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext", "x<|ENDOFTEXT|>"]
    for text in [*odd, *texts.values()]:
        assert packing.encode(text, path, ranks).tolist() == plain.encode(text, add_special_tokens=False).ids
    assert packing.encode("<|endoftext|>", path, ranks).tolist() == [50256]


PLAIN = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=12), st.sampled_from(["<|endoftext|>", "<|", "|>", "endoftext", " ", "\n", "'s"])), max_size=10))
def test_ids_of_any_text_are_those_of_the_tokenizer(parts):
    path, ranks = public_tokenizers.path(packing.TOKENIZER), public_tokenizers.path(packing.RANKS)
    assert packing.encode("".join(parts), path, ranks).tolist() == PLAIN.encode("".join(parts), add_special_tokens=False).ids


def test_ids_of_all_code_points_are_those_of_the_tokenizer():
    """In words, behind blanks, before and after digits and marks: what the two libraries' patterns look at."""
    path, ranks = public_tokenizers.path(packing.TOKENIZER), public_tokenizers.path(packing.RANKS)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 64):
        text = "".join(f"a{c} {c}1{c}!\n{c}b" for c in points[i : i + 64])
        assert packing.encode(text, path, ranks).tolist() == PLAIN.encode(text, add_special_tokens=False).ids


def test_patterns_place_most_sequences():
    dice = np.random.default_rng(2)
    lengths, n = np.unique(np.minimum(2048, dice.lognormal(6, 1.2, 4000).astype(int) + 1), return_counts=True)
    counts = dict(zip(lengths.tolist(), n.tolist(), strict=True))
    planned = packing.plan(counts)
    total = sum(n for _, n in planned)
    few = sum(n for p, n in planned if len(p) <= 3)
    assert total <= 1.01 * sum(p * n for p, n in counts.items()) / 2048 + 1 and few > 0.5 * total


def test_packing_is_whole_and_tight(spark, docs, texts):
    plain = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    rows = packing.op7(docs).collect()
    places, by_doc = {}, {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 2048
    for i, found in by_doc.items():
        ids = np.array([*plain.encode(texts[i], add_special_tokens=False).ids, 0], "<u4")
        found.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in found] == list(range(-(-len(ids) // 2048)))
        assert sum(r["length"] for r in found) == len(ids) and all(r["length"] == 2048 for r in found[1:])
        for r in found:
            assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
    assert by_doc.keys() == texts.keys()
    tokens = sum(r["length"] for r in rows)
    assert len(places) <= 1.02 * tokens / 2048 + 2


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20))
def test_plans_hold_just_the_pieces(counts):
    planned = packing.plan(counts, 64)
    used = {}
    for pattern, n in planned:
        assert sum(pattern) <= 64 and n > 0
        for length in pattern:
            used[length] = used.get(length, 0) + n
    assert used == counts
    slots = packing.Slots(planned)
    assert slots.n_sequences == sum(n for _, n in planned)
    lengths = np.array([x for x, n in counts.items() for _ in range(n)], np.int64)
    ranks = np.array([i for _, n in counts.items() for i in range(n)], np.int64)
    taken = set()
    for length, s, o in zip(lengths, *slots.place(lengths, ranks), strict=True):
        cells = {(s, o + k) for k in range(length)}
        assert not cells & taken and o + length <= 64
        taken |= cells


# 10


def test_archives_round_trip(spark):
    html = ["<p>a</p>", "<p>a</p>", "", None, "é" * 70_000, "<p>a</p>", "x\r\n\r\ny", "<p>a</p>"]
    rows = [(i if i != 7 else None, f"http://h/{i}\n" if i % 2 else None, h) for i, h in enumerate(html)] + [(0, "again", "<p>a</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = fresh_path(spark, "test-archives")
    warc.write_archives(pages, path)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r["page_id"], []).append(r)
    for i, _, h in rows[:8]:
        body = (h or "").encode()
        for r in by_id[i]:
            assert r["payload_bytes"] == len(body) and r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
            same = [j for j, x in enumerate(html) if (x or "") == (h or "") and j != 7]
            assert r["record_type"] == ("response" if i == same[0] else "revisit") and r["refers_to"] == (None if i == same[0] else same[0])
            assert r["payload"] == (body if i == same[0] else None)
    files = spark.read.format("binaryFile").load(path).collect()
    assert all(f["path"].endswith(".warc.zst") and f["content"][:4] == b"\x5d\x2a\x4d\x18" for f in files if f["length"])
    empty = fresh_path(spark, "test-archives")
    warc.write_archives(pages.limit(0), empty)
    assert warc.read_archives(spark, empty).count() == 0


def test_archives_roll_over_and_many_repeats_are_shuffled(spark, monkeypatch):
    pages = spark.range(400).selectExpr("id page_id", "concat('http://h/', id) url", "repeat(concat('page ', case when id < 150 then 0 when id % 2 = 0 then id else id div 4 end, ' '), 50) html", "1 payload", "2 digest")
    expected = {(r["page_id"], r["original"]) for r in warc.with_originals(pages).collect()}
    monkeypatch.setattr(warc, "BROADCAST_PAYLOADS", 0)
    assert {(r["page_id"], r["original"]) for r in warc.with_originals(pages).collect()} == expected and (149, 0) in expected
    path = fresh_path(spark, "test-archives")
    warc.write_archives(pages.coalesce(2), path, archive_bytes=20_000, date="2020-02-02T00:00:00Z")
    files = spark.read.format("binaryFile").load(path).collect()
    assert len(files) > 5
    assert all(sum(map(len, warc.frames(f["content"]))) < 21_000 for f in files)
    records = [r for f in files for r in warc.frames(f["content"])]
    assert all(b"WARC-Date: 2020-02-02T00:00:00Z" in r for r in records) and len({r.split(b"WARC-Record-ID: ")[1].split(b"\r\n")[0] for r in records}) == len(records)
    got = {(r["page_id"], r["refers_to"]) for r in warc.read_archives(spark, path).collect()}
    assert got == {(i, o if o != i else None) for i, o in expected}


def test_small_payloads_can_be_left_alone(spark):
    pages = spark.createDataFrame([(1, None, "ab"), (2, None, "ab")], "page_id long, url string, html string")
    assert [r["original"] for r in warc.with_originals(pages, 3).collect()] == [None, None]


def test_records_are_read_one_by_one():
    date = "2024-01-01T00:00:00Z"
    frames = warc.compressed([warc.information("a", date), *(warc.record(i, None, b"page %d " % i * 40, None, date) for i in range(50))])
    joined = b"".join(f + warc.LINE_FEED_FRAME + b"\n" for f in frames)
    assert [r and r[0] for r in map(warc.parse, warc.frames(joined + joined))] == [None, *range(50)] * 2
    assert list(warc.frames(b"")) == [] and warc.compressed([]) == []
    with pytest.raises(ValueError):
        list(warc.frames(frames[0] + frames[1][:-3]))


# 3


def sentence(dice, n):
    return " ".join("".join(dice.choice("etaoinshrdlucm") for _ in range(dice.randint(2, 9))) for _ in range(n))


def test_repeated_passages_are_found_and_clean_documents_left(spark):
    dice = random.Random(9)
    passages = [sentence(dice, 60) for _ in range(40)]
    clean = [sentence(dice, 300) for _ in range(40)]
    holders = [f"{sentence(dice, dice.randint(0, 80))} {p} {sentence(dice, dice.randint(0, 80))}" for p in passages for _ in range(2)]
    rows = documents(spark, clean + holders)
    found = substrings.repeats(rows).collect()
    flagged = {r["doc_id"] for r in found}
    assert not flagged & set(range(40))
    assert len(flagged) >= 78
    texts = dict(enumerate(clean + holders))
    for r in found:
        part = texts[r["doc_id"]].encode()[r["start_byte"] : r["end_byte"]]
        assert sum(part in t.encode() for t in texts.values()) >= 2
    cleaned = {r["doc_id"]: r["text"] for r in substrings.remove_repeats(rows).collect()}
    assert all(cleaned[i] == texts[i] for i in range(40))
    assert sum(len(cleaned[i]) for i in range(41, 120, 2)) < 0.9 * sum(len(texts[i]) for i in range(41, 120, 2))
    assert all(cleaned[i] == texts[i] for i in range(40, 120, 2))


def edges(data, gear):
    ends = substrings.boundaries(data, gear).tolist()
    return [0, *ends[:-1]], ends


def plain_repeats(texts_):
    """Every unit of every document looked up among all of them, one by one."""
    gear = substrings.gear_table()
    spans = [list(zip(*edges(t.encode(), gear), strict=True)) for t in texts_]
    where = {}
    for i, cut in enumerate(spans):
        for (a, _), (_, e) in zip(cut, cut[1:], strict=False):
            where.setdefault(texts_[i].encode()[a:e], []).append((i, a))
    out = set()
    for i, cut in enumerate(spans):
        found = []
        for (a, m), (_, e) in zip(cut, cut[1:], strict=False):
            places = where[texts_[i].encode()[a:e]]
            if len(places) > 1:
                found.append((a, m, e, 2 if min(p for p in places if p[0] == i) < (i, a) else 0, min(places)[0]))
        out |= {(i, *part) for part in substrings.passages(i, found, substrings.RUN)}
    return out


def test_repeats_are_those_of_the_plain_search(spark):
    dice = random.Random(31)
    pool = [sentence(dice, n) for n in (8, 12, 30, 50, 60, 70, 90)] + ["na " * 300, "x" * 700, "é" * 400]
    texts_ = []
    for _ in range(60):
        texts_.append(" ".join(dice.choice(pool) if dice.random() < 0.4 else sentence(dice, dice.randint(1, 40)) for _ in range(dice.randint(1, 8))))
    got = [tuple(r[c] for c in ("doc_id", "start_byte", "end_byte", "n_chunks", "first_doc", "is_first")) for r in substrings.repeats(documents(spark, texts_)).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_repeats(texts_)


def test_repeats_within_a_document_and_periodic_passages(spark):
    dice = random.Random(33)
    p, q = sentence(dice, 80), sentence(dice, 80)
    rows = documents(spark, [f"{p} {q} {sentence(dice, 30)} {p}", "x" * 5000 + sentence(dice, 50), sentence(dice, 50) + "x" * 3000])
    found = substrings.repeats(rows).collect()
    cleaned = {r["doc_id"]: r["text"] for r in substrings.remove_repeats(rows).collect()}
    assert any(r["doc_id"] == 0 and not r["is_first"] and r["first_doc"] == 0 for r in found)
    assert cleaned[0].startswith(f"{p} {q}") and p[60:-60] not in cleaned[0][len(p) :]
    assert cleaned[1].count("x") < 1000 and cleaned[2].count("x") < 1000


def test_texts_that_share_an_id_are_cut_by_their_own_places(spark):
    dice = random.Random(35)
    p = sentence(dice, 90)
    a, b, c = f"{p} {sentence(dice, 20)}", f"{sentence(dice, 60)} {p} {sentence(dice, 9)}", sentence(dice, 300)
    rows = spark.createDataFrame([(1, a), (2, b), (2, c), (2, b), (None, b), (3, None), (4, "")], "doc_id long, text string")
    got = substrings.remove_repeats(rows.withColumns({n: F.lit(7) for n in ("c_who", "c_h", "_c_h", "c_cuts", "who", "start")}))
    texts_ = sorted(((r["doc_id"] or 0, r["text"]) for r in got.collect()), key=str)
    assert (2, c) in texts_ and (1, a) in texts_ and (3, None) in texts_ and (4, "") in texts_ and len(texts_) == 7
    cut = [t for i, t in texts_ if i == 2 and t != c]
    assert len(cut) == 2 and cut[0] == cut[1] and p[60:-60] not in cut[0] and cut[0][:40] == b[:40]


def test_what_is_removed_stands_in_its_first_document(spark):
    dice = random.Random(12)
    line, passage, other = sentence(dice, 40), sentence(dice, 80), sentence(dice, 60)
    chance = passage[200:290]
    own = [sentence(dice, 80) for _ in range(8)]
    # The line, and a few chunks of the passage, come first in earlier documents than the passage does.
    held = [f"{own[0]} {line} {own[1]}", f"{own[2]} {chance} {own[3]}", f"{own[4]} {line} {passage} {own[5]}", f"{own[6]} {line} {passage} {other}", f"{line} {passage} {other} {own[7]}"]
    cleaned = {r["doc_id"]: r["text"] for r in substrings.remove_repeats(documents(spark, held)).collect()}
    gear = substrings.gear_table()
    cuts = {(r["doc_id"], r["start_byte"], r["end_byte"]) for r in substrings.repeats(documents(spark, held)).collect() if not r["is_first"]}
    stands, removed = set(), set()
    for i, t in enumerate(held):
        for a, b in zip(*edges(t.encode(), gear), strict=True):
            (removed if any(i == j and s <= a and b <= e for j, s, e in cuts) else stands).add(t.encode()[a:b])
    assert removed and removed <= stands
    assert cleaned[0] == held[0] and cleaned[1] == held[1]
    assert passage[60:] in cleaned[2] and line[60:-60] not in cleaned[2]
    assert other[60:] in cleaned[3] and passage[60:-60] not in cleaned[3]
    assert other[60:-60] not in cleaned[4] and passage[60:-60] not in cleaned[4]


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=400), st.binary(max_size=60), st.integers(0, 400))
def test_chunks_are_whole_and_resist_insertions(data, inserted, at):
    """The plain rolling hash, one byte at a time, gives the same places."""
    data = data[:at] + inserted + data[at:]
    gear = substrings.gear_table()
    h, plain, last = 0, [], -substrings.LEAST
    for i, b in enumerate(data):
        h = ((h << 1) + int(gear[b])) & 0xFFFF
        if h < 65536 // substrings.MEAN and i + 1 - last >= substrings.LEAST:
            last = i + 1
            plain.append(last)
        elif i + 1 - (plain[-1] if plain else 0) == substrings.MOST:
            plain.append(i + 1)
    if data and (not plain or plain[-1] != len(data)):
        plain.append(len(data))
    assert substrings.boundaries(data, gear).tolist() == plain


# 8


def test_quality_catches_bad_and_keeps_good(spark):
    """Toxic words are learned from two thirds of the labels; the rates are those of the last third."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    given = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = {r["doc_id"] for r in given.filter(langid.held_out(F.col("doc_id"))).collect()}
    labels = {r["doc_id"]: r for r in given.collect()}
    got = {r["doc_id"]: r for r in quality.op8(docs, given.filter(~langid.held_out(F.col("doc_id")))).collect()}
    assert got.keys() == {r["doc_id"] for r in docs.select("doc_id").collect()}
    good = [i for i in out if labels[i]["quality"] and not labels[i]["toxic"]]
    toxic = [i for i in out if labels[i]["toxic"]]
    low = [i for i in out if not labels[i]["quality"]]
    assert len(good) > 500 and len(toxic) > 50 and len(low) > 50
    assert sum(got[i]["kept"] for i in good) / len(good) > 0.95
    assert sum(not got[i]["kept"] for i in toxic) / len(toxic) > 0.9
    assert sum(not got[i]["kept"] for i in low) / len(low) > 0.9


def test_scores_do_not_depend_on_the_path(spark, docs):
    given = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.learn(docs, given)
    by_text = {r["doc_id"]: (r["p_good"] >= 0.5, round(r["p_good"], 6)) for r in quality.score(docs, model).collect()}
    assert {r["doc_id"]: (r["kept"], round(r["p_good"], 6)) for r in quality.op8(docs, given).collect()} == by_text
    assert {r["doc_id"] for r in quality.keep_good(docs, given).collect()} == {i for i, (kept, _) in by_text.items() if kept}


@pytest.mark.parametrize("labels", [[], [(1, None, None), (None, 1, 1), (999, 1, 1)], [(0, 1, 0), (0, 1, 1), (0, 0, None), (0, 1, 1)]])
def test_odd_labels(spark, labels):
    """Empty, null, of no document, repeated and contradicting."""
    rows = documents(spark, ["some plain words here.", None, ""])
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert {r["doc_id"] for r in quality.op8(rows, given).collect()} == {0, 1, 2}


def test_label_model_finds_the_accuracies():
    dice = random.Random(4)
    rates = dict(zip(quality.NAMES, [0.95, 0.9, 0.85, 0.8, 0.9, 0.7, 0.85, 0.8], strict=True))
    counts = {}
    for _ in range(8000):
        truth = dice.random() < 0.7
        votes = [0 if dice.random() < 0.2 else (1 if truth == (dice.random() < r) else -1) for r in rates.values()]
        code = quality.pattern_of(votes)
        assert quality.votes_of(code) == votes
        counts[code] = counts.get(code, 0) + 1
    model = quality.LabelModel(counts)
    assert abs(model.share[0] - 0.7) < 0.03
    assert all(abs(model.accuracies()[n] - r) < 0.05 for n, r in rates.items())


def test_prefixes_are_learned_from_labels(spark):
    dice = random.Random(2)
    word = lambda: pick(dice, "etaoinshr", 8)
    sample = [(" ".join([word() for _ in range(60)] + (["zzzzz" + word() for _ in range(3)] + ["qq"] if i % 10 == 0 else ["mmmmm"] * (i % 20 == 5))), int(i % 10 == 0)) for i in range(200)]
    rows = spark.createDataFrame(sample, "text string, toxic int")
    assert quality.learn_prefixes(rows) == {"zzzzz": 0.0, "qq": 0.0}
    # Seven toxic texts are too few, however many copies of them there are.
    few = documents(spark, [t for t, toxic in sample if toxic][:7] * 4)
    assert quality.rules_of(few, few.select("doc_id", F.lit(1).alias("toxic"))) == {}
    assert quality.rules_of(documents(spark, [t for t, _ in sample]), few.limit(0).select("doc_id", F.lit(1).alias("toxic"))) == {}
    assert quality.Analysis("zzzzzab and more", {"zzzzz": 0.0}).votes[0] == quality.BAD
    # A beginning that others have too marks only from a share on.
    shared = [(" ".join(["a"] * 97 + ["mmmmm"] * n), int(n == 3)) for n in (1, 3) for _ in range(1)] + [(" ".join([str(i)] * 97 + ["mmmmm"] * (3 if i % 2 else 1)), i % 2) for i in range(40)]
    found = quality.learn_prefixes(spark.createDataFrame(shared, "text string, toxic int"))
    assert found == {"mmmmm": 0.015}


def test_copies_do_not_fill_the_sample(spark, monkeypatch):
    # The text that is copied comes first by its hash, whatever the share.
    hashes = spark.sql("select text, pmod(h, 1 << 30) / (1 << 30) p, h from (select *, xxhash64(text) h from (select concat('copied text ', id) text from range(20000)))")
    copied = hashes.filter("p < 0.005").orderBy("h").first()["text"]
    rows = spark.range(4000).selectExpr("id doc_id", f"if(id < 3000, '{copied}', concat('a text of its own ', id)) text")
    seen = []
    monkeypatch.setattr(quality, "train", lambda rows, labels: seen.extend(rows) or np.zeros(quality.BUCKETS + 1))
    quality.learn(rows, sample_docs=50)
    assert len(seen) == 50 and len({at.tobytes() for at, _ in seen}) == 50


# 2


@pytest.mark.parametrize(("left", "right"), [(16384, 65536), (7, 9)])
def test_vector_links_are_all_pairs(spark, left, right):
    """Small limits deal a cell out over several tasks."""
    dice = np.random.default_rng(8)
    rows = dice.standard_normal((60, 16))
    rows = np.concatenate([rows, rows[:25] + 0.15 * dice.standard_normal((25, 16)), rows[:10] * 3, rows[:5], rows[:12] + 0.25 * dice.standard_normal((12, 16))])
    vecs = [(i, v.astype(np.float32).tolist(), 1) for i, v in enumerate(rows)]
    n = len(vecs)
    vecs += [(n, None, 0), (n + 1, [], 0), (n + 2, [0.0] * 16, 0), (n + 3, [float("nan")] * 16, 0), (n + 4, [None] + [1.0] * 15, 0), (n + 5, [1.0] * 3, 0), (n + 6, [2.0] * 3, 0)]
    frame = spark.createDataFrame(vecs, "vec_id long, embedding array<float>, kept int")
    fit = {i: v for i, v, _ in vecs[:n]} | {n + 5: vecs[n + 5][1], n + 6: vecs[n + 6][1]}
    linked = lambda a, b: len(fit[a]) == len(fit[b]) and cosine(fit[a], fit[b]) >= 0.9
    comp = components(fit, linked)
    got = {r["vec_id"]: r for r in vectors.near_duplicates(frame, left=left, right=right).collect()}
    assert len(got) == len(vecs)
    for i, r in got.items():
        assert r["n_links"] == (sum(linked(i, j) for j in fit if j != i) if i in fit else 0)
        assert r["component_id"] == comp.get(i, i) and r["kept"] == (comp.get(i, i) == i)


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    vecs = [(1, [1e200, 1e200]), (2, [1e200, 1.0001e200]), (3, [1e-200, 1e-200]), (4, [1.0, 1.0]), (5, [5e-324, 0.0]), (6, [1.0, 0.0]), (7, [inf, 1.0]), (8, [-0.0, 2.0]), (9, [0.0, 2.0]), (9, [0.0, 2.0]), (9, [-1.0, -1.0]), (10, [nan, 1.0]), (None, [1.0, 1.0]), (11, None), (11, [])]
    frame = spark.createDataFrame(vecs, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("exact", "h", "_h", "node", "n", "least", "component", "kept", "rep")})
    got = vectors.near_duplicates(frame).collect()
    assert len(got) == len(vecs) and all(r["node"] == "x" and r["_h"] == "x" for r in got)
    links = sorted(((r["vec_id"] or 0), r["n_links"], r["component_id"]) for r in got)
    assert links == sorted([(1, 3, 1), (2, 3, 1), (3, 3, 1), (4, 3, 1), (5, 1, 5), (6, 1, 5), (7, 0, 7), (8, 2, 8), (9, 2, 8), (9, 2, 8), (9, 0, 9), (10, 0, 10), (0, 0, None), (11, 0, 11), (11, 0, 11)])
    assert vectors.near_duplicates(frame.limit(0)).count() == 0


@pytest.mark.parametrize(("n", "dim"), [(3000, 64), (700, 5)])
def test_orthants_lose_no_pair(n, dim):
    dice = np.random.default_rng(n)
    rows = vectors.units(list(np.concatenate([dice.standard_normal((n, dim)), np.abs(dice.standard_normal((n // 4, dim)))])))
    rows = np.concatenate([rows, vectors.units(list(rows[: n // 3] + 0.3 / np.sqrt(dim) * dice.standard_normal((n // 3, dim))))])
    ids, one = np.arange(len(rows)), np.ones(len(rows), np.int64)
    gains = np.zeros(len(rows), np.int64)
    for block in range(4):
        rep, gain, _ = vectors.compare(dim, block, 4, 0.9, (ids, one, rows), (ids, one, rows), same=True)
        np.add.at(gains, rep, gain)
    near = rows @ rows.T >= 0.9
    assert gains.tolist() == (near.sum(1) - 1).tolist() and gains.sum() > n // 4


def test_vector_query_is_all_pairs(spark):
    frame = spark.read.parquet(f"{SF}/embeddings.parquet")
    m = {r["vec_id"]: np.array(r["embedding"], float) for r in frame.collect()}
    ids = sorted(m)
    x = np.stack([m[i] / np.sqrt(m[i] @ m[i]) for i in ids])
    near = x @ x.T >= 0.9
    got = {r["vec_id"]: r["n_links"] for r in vectors.op2(frame).collect()}
    assert got == {i: int(near[k].sum()) - 1 for k, i in enumerate(ids)}
