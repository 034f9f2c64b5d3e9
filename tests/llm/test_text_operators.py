"""Language ID, licences, personal data and decontamination against brute force."""

import hashlib
import pickle
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import NASTY, SCHEMA, empty, frame, words
from tidewell.llm import bytekit, decontam, langid, license, pii

EN = "the of and to in that is was for with on as by at from".split()
FR = "le la les de des et en un une que qui dans pour pas sur".split()


def speech(rng, vocabulary, n=60):
    return " ".join(rng.choice(vocabulary) + rng.choice(("", "", "", "ment" if vocabulary is FR else "ing")) for _ in range(n))


def lingual(n=200):
    rng = random.Random(3)
    return [(i, speech(rng, EN if i % 2 else FR), "en" if i % 2 else "fr", "s") for i in range(n)]


def test_language_held_out_accuracy(spark):
    rows = [*lingual(), (900, None, "en", "s"), (901, "123 - 456", "en", "s"), (902, "", None, "s"), (None, "the of and", None, None)]
    got = {r["doc_id"]: r for r in langid.train_and_identify(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    held = [r for r in rows[:200] if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert {i for i in range(200) if got[i]["held_out"]} == {r[0] for r in held}
    assert np.mean([got[r[0]]["lang_pred"] == r[2] for r in held]) > 0.95
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and got[None]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["score"] for r in got.values() if r["lang_pred"] == "und"} == {0.0} and all(r["score"] >= 0.5 for r in got.values() if r["lang_pred"] != "und")


def test_language_without_labels_or_rows(spark):
    assert langid.train_and_identify(empty(spark)).count() == 0
    rows = [(1, "abc", None, "s"), (1, "abc", None, "s")]
    assert [r["lang_pred"] for r in langid.train_and_identify(frame(spark, rows)).collect()] == ["und", "und"]
    assert langid.keep_identified(frame(spark, rows)).count() == 0
    kept = langid.keep_identified(frame(spark, [*lingual(40), (99, None, "en", "s"), (98, "12", "en", "s")]))
    assert kept.count() == 40 and kept.schema == SCHEMA


def slow_ppm(model, lang, data):
    """Code length by walking the contexts of one language, byte by byte, with exclusion."""
    counts = [{} for _ in range(4)]
    for lg, code, n in zip(model.lang, model.code.tolist(), model.count, strict=True):
        for order in range(4):
            ctx = (code >> 8) & (256**order - 1)
            counts[order].setdefault(ctx, {}).setdefault(lg, {}).setdefault(code & 255, 0)
            counts[order][ctx][lg][code & 255] += n
    nodes = [{c for c, by in level.items() if order == 0 or sum(sum(x.values()) for x in by.values()) >= 2} for order, level in enumerate(counts)]
    bits = 0.0
    for i, b in enumerate(data):
        past = [data[i - k] if i >= k else 0 for k in range(1, 4)]
        ctx = [sum(past[k] << 8 * k for k in range(order)) for order in range(4)]

        def p(order):
            while order > 0 and ctx[order] not in nodes[order]:
                order -= 1
            lower = np.full(256, 1 / 256) if order == 0 else p(order - 1)
            own = counts[order].get(ctx[order], {}).get(lang)
            if not own:
                return lower
            c = np.array([own.get(s, 0) for s in range(256)], float)
            rest = np.where(c > 0, 0, lower)
            if rest.sum() == 0:
                return c / c.sum()
            kinds = (c > 0).sum()
            return c / (c.sum() + kinds) + kinds / (c.sum() + kinds) * rest / rest.sum()

        bits -= np.log2(p(3)[b])
    return bits


def test_code_lengths_are_exact():
    texts = ["abracadabra", "banana band", "", "zz", "aé"]
    data, offsets = bytekit.buffers(pa.array(texts))
    key, n = np.unique((np.repeat([0, 1, 0, 1, 0], np.diff(offsets)).astype(np.int64) << 32) | langid._grams(data, offsets).astype(np.int64), return_counts=True)
    model = langid.PpmModel(["x", "y"], key >> 32, (key & 0xFFFFFFFF).astype(np.uint32), n.astype(float), 6000)
    got = langid.code_lengths(data, offsets, *model.tables())
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx([slow_ppm(model, lg, t.encode()) for lg in (0, 1)], rel=1e-4, abs=1e-4)


def test_code_lengths_of_long_rows():
    """Rows longer than a slice, and rows around its edge, cost what their bytes cost one by one."""
    rng = random.Random(8)
    long = speech(rng, EN, 90_000)
    texts = [speech(rng, FR, 3), long, "", "z", long[: langid.PIECE - 3], "é" * 50]
    assert len(long) > langid.PIECE
    data, offsets = bytekit.buffers(pa.array(texts))
    codes = langid._grams(data, offsets)
    key, n = np.unique(codes[:5000], return_counts=True)
    order0, levels = langid.PpmModel(["x", "y"], np.arange(len(key)) % 2, key, n.astype(float)).tables()
    each = langid.costs(codes, order0, levels)
    want = [each[a:b].sum(0) for a, b in zip(offsets, offsets[1:], strict=False)]
    assert langid.code_lengths(data, offsets, order0, levels) == pytest.approx(np.array(want), rel=1e-9)


def test_many_languages():
    """Every language keeps all its contexts: what 200 languages cost on a text is what each costs on its own."""
    rng = random.Random(9)
    texts = [words(rng, 40, 60 + i) for i in range(200)]
    parts = []
    for i, t in enumerate(texts):
        data, offsets = bytekit.buffers(pa.array([t * 2]))
        code, n = np.unique(langid._grams(data, offsets), return_counts=True)
        parts.append((np.full(len(code), i), code, n.astype(float)))
    lang, code, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    names = [f"l{i:03}" for i in range(200)]
    data, offsets = bytekit.buffers(pa.array(texts[:9]))
    got = langid.code_lengths(data, offsets, *langid.PpmModel(names, lang, code, n).tables())
    assert (got.argmin(1) == np.arange(9)).all()
    for i in (0, 3, 8):
        alone = langid.code_lengths(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]), *langid.PpmModel(["x"], parts[i][0] * 0, *parts[i][1:]).tables())
        assert got[i, i] == pytest.approx(alone[0, 0], rel=0.02)  # (contexts seen once there and once elsewhere enter as well)


def test_language_stage_rejects_what_no_language_predicts(spark):
    """All rows have letters, of the same alphabet; only the trees tell them apart."""
    rng = random.Random(4)
    noise = [(1000 + i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(200)), None, "s") for i in range(20)]
    rows = [*lingual(), *noise, noise[0], lingual()[5], (2000, None, "en", "s"), (2001, "", None, None), (2002, "12 34", "fr", "s")]
    model_rows = frame(spark, rows)
    kept = langid.keep_identified(model_rows)
    assert kept.schema == SCHEMA and sorted(r["doc_id"] for r in kept.collect()) == sorted([*range(200), 5])
    assert langid.keep_identified(empty(spark)).count() == 0


FOREIGN = [
    "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему.",
    "今日は天気がいいから散歩に行きましょう。明日は雨が降るかもしれません。",
    "天地玄黄，宇宙洪荒。日月盈昃，辰宿列张。",
    "أهلا وسهلا بكم في مدينتنا الجميلة",
    "x = {k: f(v) for k, v in d.items() if not _q(k)}; #!/bin/sh && [[ $X -gt 0x7F ]]",
]


def test_language_stage_rejects_scripts_that_no_tree_has_learned(spark):
    """Neither tree codes them below 8 bits a byte, or below the byte frequencies; their scores tell that both trees fail alike."""
    rows = [*lingual(), *[(1000 + i, t * n, None, "s") for i, t in enumerate(FOREIGN) for n in (1, 30)]]
    assert sorted(r["doc_id"] for r in langid.keep_identified(frame(spark, rows)).collect()) == list(range(200))
    got = {r["doc_id"]: r["score"] for r in langid.train_and_identify(frame(spark, rows)).collect()}
    known = np.mean([got[i] for i in range(200)])
    assert all(0.5 <= got[1000 + i] < known for i in range(4))
    # a script is known once rows of it are learned
    more = [(2000 + i, FOREIGN[0], "ru", "s") for i in range(8)]
    assert {1000} <= {r["doc_id"] for r in langid.keep_identified(frame(spark, [*rows, *more])).collect()}


def test_language_sample_is_bounded_in_bytes(spark):
    """Documents beyond the sixteenth of the bound are not learned from, but identified; a language of such documents only is not learned."""
    rows = [*lingual(400), (1000, speech(random.Random(5), EN, 4000), "long", "s"), (1001, speech(random.Random(6), FR, 4000), "fr", "s")]
    docs = frame(spark, rows)

    def bytes_seen(model):
        # each byte of the sample is one count
        return pickle.loads(zlib.decompress(model)).count.sum()

    assert pickle.loads(zlib.decompress(langid.fit(docs))).languages == ["en", "fr", "long"]
    model = langid.fit(docs, sample_bytes=16_384)
    assert pickle.loads(zlib.decompress(model)).languages == ["en", "fr"] and bytes_seen(model) < 2 * 2 * 16_384 < bytes_seen(langid.fit(docs))
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, model).collect()}
    assert got[1000] == "en" and got[1001] == "fr" and np.mean([got[i] == ("en" if i % 2 else "fr") for i in range(400)]) > 0.95


LICENCES = [
    (1, "Released under the MIT License. The mit-license!", "en", "s"),
    (2, "This work is licensed under the GNU General Public License, version 3.", "en", "s"),
    (3, "Licensed under CC BY-NC 4.0. and cc by", "en", "s"),
    (4, "Licensed under the Apache\nLicense, Version 2.0 apache license", "en", "s"),
    (5, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "en", "s"),
    (6, "mit licenses, gnu general public, general public license, mité license", "en", "s"),
]


def test_licences(spark):
    rows = LICENCES + NASTY
    got = sorted(license.scan(frame(spark, rows)).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_words"]))
    want = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r[1] or "").lower()))))
    for r, (_, text, *_rest) in zip(got, want, strict=True):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        found = sorted((i, lab) for p, lab in license.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        assert (r["n_words"], r["n_base"]) == (len(w), len(found)), text
        assert (r["first_word"], r["last_word"]) == ((found[0][0], found[-1][0]) if found else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in found}))
        assert {x for _, x in found} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    labels = {r["doc_id"]: r["labels"] for r in license.scan(frame(spark, LICENCES)).collect()}
    assert labels == {1: "mit", 2: "gpl,gpl-3.0", 3: "cc-by,cc-by-nc", 4: "apache,apache-2.0", 5: "mit-text", 6: ""}
    assert license.scan(empty(spark)).count() == 0


def test_licences_in_one_file(spark):
    """Every passage votes, however many others stand in the file."""
    some = ("bsd", "mit-text", "isc", "cc-by-sa", "apache-2.0")
    rows = [(1, "\n\n".join(license.TEMPLATES[x][0] for x in some), "en", "s"), (2, " x ".join(t for t, _ in license.TEMPLATES.values()), "en", "s"), (3, "x " * 300 + "the of and to in " * 40, "en", "s")]
    got = {r["doc_id"]: r for r in license.scan(frame(spark, rows + NASTY)).collect() if r["n_base"] or r["labels"] or r["doc_id"] == 3}
    assert set(some) <= set(got[1]["labels"].split(","))
    assert set(license.TEMPLATES) <= set(got[2]["labels"].split(","))
    assert got[3]["labels"] == ""


def slow_labels(texts):
    """Every template at every place of every file: the share of its IDF at its places, and its mandatory phrases."""
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    files = [find(t) for t in texts]
    idf = lambda w: np.log((len(files) + 1) / (sum(w in f for f in files) + 1)) + 1e-3
    out = []
    for f in files:
        labels, best = {x for p, x in license.PHRASES.items() if p in " ".join(f) and any(f[i : i + len(p.split())] == p.split() for i in range(len(f)))}, 0.0
        base = bool(labels)
        for label, (passage, phrases) in license.TEMPLATES.items():
            t = passage.split()
            weights = [idf(w) for w in t]
            for begin in range(-len(t) + 1, len(f)):
                hits = [j for j in range(len(t)) if 0 <= begin + j < len(f) and f[begin + j] == t[j]]
                share = min(1.0, sum(weights[j] for j in hits) / sum(weights)) if len(hits) >= 2 else 0.0
                best = max(best, share)
                stretch = f[max(0, begin) : max(0, begin + len(t))]
                if share >= license.COVERAGE and all(any(stretch[i : i + len(p.split())] == p.split() for i in range(len(stretch))) for p in phrases):
                    labels.add(label)
        out.append((",".join(sorted(labels)), 1.0 if base else best))
    return out


def test_licence_labels_against_brute_force(spark):
    rng = random.Random(10)
    rows = [*LICENCES, (7, None, None, None), (8, "", "en", "s")]
    for i in range(40):
        parts = [rng.choice(list(license.TEMPLATES.values()))[0].split() for _ in range(rng.randrange(3))]
        for p in parts:
            for _ in range(rng.randrange(4)):
                p[rng.randrange(len(p))] = rng.choice(("the", "license", "x", "y"))
        rows.append((100 + i, words(rng, 12) + " " + " z ".join(" ".join(p[rng.randrange(3) :]) for p in parts), "en", "s"))
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license.scan(frame(spark, rows)).collect()}
    for (i, *_), (labels, best) in zip(rows, slow_labels([r[1] for r in rows]), strict=True):
        assert got[i][0] == labels and got[i][1] == pytest.approx(best, abs=1e-9), rows[[r[0] for r in rows].index(i)]


PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def slow_pii(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            odd = [int(d) for d in digits[-1::-2]] + [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (14 <= len(digits) <= 19 and sum(odd) % 10 == 0) or kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.-_%+ 0124(é", max_size=40))
def test_pii_patterns(text):
    assert [s for s in pii.spans(text) if s[1] < 4] == slow_pii(text)


def test_pii_rows(spark):
    rows = [(1, "é card 4111 1111 1111 1111, mail a.b@c.de, 10.0.0.255 and +49 (30) 1234-5678", "en", "s"), (2, "iban DE89370400440532013000", "en", "s"), *NASTY]
    got = pii.scan(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    one = next(r for r in got if r["doc_id"] == 1 and r["n_card"])
    assert (one["n_email"], one["n_ip"], one["n_card"], one["n_phone"]) == (1, 1, 1, 1)
    want = slow_pii(rows[0][1])
    assert one["base_sha256"] == hashlib.sha256(",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in want).encode()).hexdigest()
    assert one["scores"].split(",")[0] == "0.90"  # the word card stands before the card
    assert "iban:5:27" in next(r for r in got if r["doc_id"] == 2 and r["n_iban"])["spans"]
    assert all(r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in got if r["spans"] == "")
    assert pii.scan(empty(spark)).count() == 0


def slow_iban(text):
    """All maximal runs of letters and digits that have the form of an IBAN and the remainder 1."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9]+", text):
        if re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", m[0]):
            number = 0
            for c in m[0][4:] + m[0][:4]:
                v = ord(c) - 48 if c.isdigit() else ord(c) - 55
                number = (number * (10 if v < 10 else 100) + v) % 97
            if number == 1:
                out.append((m.start(), m.end()))
    return out


def test_ibans_and_scores_against_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        body = "".join(rng.choice("ABCXYZ0123456789") for _ in range(rng.randrange(9, 32)))
        country = rng.choice(("DE", "GB", "fr", "X1"))
        rest = "".join(str(int(c, 36)) for c in body + country.upper() + "00")
        check = f"{98 - int(rest) % 97:02d}" if rng.random() < 0.7 else "11"
        context = rng.choice(("account", "IBAN", "nothing", "xbank"))
        text = f"{context} {'f ' * rng.choice((1, 40))}é {rng.choice(('', '_', 'a'))}{country}{check}{body}{rng.choice((' ', '.', 'z'))} end"
        found = [(a, b) for a, k, b in pii.spans(text) if k == 4]
        assert found == slow_iban(text)
        for a, b in found:
            near = {w.lower() for w in re.findall("[A-Za-z]+", text[max(0, a - 60) : a] + " " + text[b : b + 60])}
            assert pii.score(text, a, b, "iban") == pytest.approx(0.95 if near & set(pii.CONTEXT["iban"]) else 0.9)


def slow_grouped(text):
    """From each word on, the longest row of groups (single spaces between) that is an IBAN; the next one begins after it."""
    found = list(re.finditer(r"[A-Za-z0-9]+", text))
    out, i = [], 0
    while i < len(found):
        hit = None
        for n in range(4, 10):
            part = found[i : i + n]
            whole = "".join(m[0] for m in part)
            joined = len(part) == n and text[part[0].start() : part[-1].end()] == " ".join(m[0] for m in part)
            fours = all(len(m[0]) == 4 for m in part[:-1]) and len(part[-1][0]) <= 4
            if joined and fours and 15 <= len(whole) <= 34 and slow_iban(whole) == [(0, len(whole))]:
                hit = n
        if hit:
            out.append((found[i].start(), found[i + hit - 1].end()))
        i += hit or 1
    return out


def test_grouped_ibans_against_brute_force():
    assert pii.spans("to DE89 3704 0044 0532 0130 00 NOW") == [(3, 4, 30)]
    rng, hits = random.Random(3), 0
    for _ in range(400):
        text = ""
        for _ in range(rng.randrange(1, 4)):
            body = "".join(rng.choice("ABCXYZ0123456789") for _ in range(rng.choice((10, 11, 12, 16, 18, 20, 23, 30, 31))))
            country = rng.choice(("DE", "GB", "ES"))
            check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
            whole = f"{country}{check if rng.random() < 0.8 else 11:02d}{body}"
            text += rng.choice(("é ", "ACCT ", "A1B2 ", "x", "", "DE12 ")) + " ".join(whole[k : k + 4] for k in range(0, len(whole), 4)) + rng.choice((" ", ". ", " NEXT ", " to ", "  ", " A "))
        got = [(a, b) for a, k, b in pii.spans(text) if k == 4]
        assert got == sorted(slow_grouped(text)), text
        hits += len(got)
    assert hits > 200


def items(spark, *texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "item_id long, text string, doc_id string")


def test_decontamination(spark):
    rng = random.Random(5)
    question = "A train leaves Boston at 9 and travels 120 miles to Albany. How many hours does the train need at 60 miles per hour?"
    again = "A train leaves Denver at 7 and travels 300 km to Tulsa. How many hours does the train need at 50 km per hour?"
    crooked = "a box holds 12 red balls and 12 blue balls so how many balls does one box of 12 hold"
    docs = [
        (1, words(rng, 50) + " " + question + " " + words(rng, 50), "en", "s"),
        (2, words(rng, 50) + " " + again + " " + words(rng, 50), "en", "s"),
        (3, "x " + crooked.replace("12", "15"), "en", "s"),
        (4, "x " + crooked.replace("12", "15", 1), "en", "s"),
        (5, "A train leaves Boston at 9 and then nothing else of it follows in this text at all", "en", "s"),
        *[(i + 10 if i is not None else None, t, a, b) for i, t, a, b in NASTY],
    ]
    found = decontam.find(frame(spark, docs), items(spark, question, crooked, None, "too short", question), block_items=2)
    got = sorted((r["doc_id"], r["item_id"], r["verbatim"]) for r in found.collect())
    assert got == [(1, 0, True), (1, 4, True), (2, 0, False), (2, 4, False), (3, 1, False)]
    kept = decontam.keep_clean(frame(spark, docs), items(spark, question, crooked))
    assert kept.count() == len(docs) - 3 and kept.schema == SCHEMA
    assert decontam.find(empty(spark), items(spark, question)).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find(frame(spark, docs), none).count() == 0 and decontam.keep_clean(frame(spark, docs), none).count() == len(docs)


def test_number_words_are_numbers(spark):
    item = "Farmer Jones owns 12 cows and buys 5 more cows at the market so how many cows does the farmer own"
    spelt = "Farmer Smith owns twelve cows and buys Five more cows at the market so how many cows does the farmer own"
    docs = [(1, spelt, "en", "s"), (2, spelt.replace("twelve", "30"), "en", "s"), (3, spelt.upper(), "en", "s"), (4, "twelve cows and five more of them went to the market", "en", "s")]
    twice = "a box holds 12 red balls and 12 blue balls so how many balls does the box of 12 hold"
    docs += [(5, twice.replace("12", "seven", 1).replace("12", "7"), "en", "s"), (6, twice.replace("12", "seven", 1), "en", "s")]
    got = decontam.find(frame(spark, docs), items(spark, item, twice)).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(1, 0), (2, 0), (3, 0), (5, 1)]


def test_window_matches_are_complete():
    """Every shared canonical window is found, whatever the slices."""
    rng = random.Random(7)
    texts = [words(rng, 80, 30) for _ in range(20)]
    index = decontam.ItemIndex([0], [words(rng, 60, 30)])
    data, offsets = bytekit.buffers(pa.array(texts))
    code, literal, _, first = decontam.canonical(data, offsets)
    mine, theirs = index.probe(*decontam.windows(code, literal, first))
    want = set()
    for row in range(20):
        for i in range(first[row], first[row + 1] - 4):
            for j in range(len(index.code) - 4):
                if (code[i : i + 5] == index.code[j : j + 5]).all() and literal[i : i + 5].sum() >= 3:
                    want.add((i, j))
    assert set(zip(mine.tolist(), theirs.tolist(), strict=True)) == want


def test_items_of_few_literal_words(spark):
    paid = "John Smith paid 12 dollars and Mary Jones paid 15 dollars"
    title = "What Is The Capital City Of France And Spain"
    docs = [
        (1, f"so we read that {paid} there", "en", "s"),
        (2, "so we read that Ann Brown paid 7 dollars and Bob White paid 9 dollars there", "en", "s"),
        (3, f"the title was {title} in it", "en", "s"),
        (4, "the title was Who Ate Our Apples From Town In June And May in it", "en", "s"),
        (5, "well seven plus four, he said", "en", "s"),
        (6, "seven plus five four", "en", "s"),
        (7, "so Ann Brown and Bob White and 7 dollars and 9 dollars", "en", "s"),
    ]
    some = items(spark, paid, title, "Seven plus four", "", "?!")
    got = sorted((r["doc_id"], r["item_id"], r["verbatim"]) for r in decontam.find(frame(spark, docs), some).collect())
    assert got == [(1, 0, True), (2, 0, False), (3, 1, True), (5, 2, True)]
    assert {r["doc_id"] for r in decontam.keep_clean(frame(spark, docs), some).collect()} == {4, 6, 7}


def test_every_copy_is_judged(spark):
    item = "a box holds 12 red balls and 12 blue balls so how many balls does one box of 12 hold"
    bad = item.replace("12", "15", 1)
    stray = "far away a box holds 99 red balls and here"
    edited = "the box holds 15 red balls and 15 blue balls so how many balls does one box of 15 hold"
    docs = [
        (1, f"x {bad} y z {item} end", "en", "s"),
        (2, f"x {bad} {bad} {item.replace('12', '20')} end", "en", "s"),
        (3, f"{stray} {'filler ' * 90} {edited}", "en", "s"),
        (4, f"{edited} {'filler ' * 90} {stray}", "en", "s"),
        (5, f"x {bad} {'filler ' * 40} {bad.replace('15', '7')}", "en", "s"),
        (6, f"{stray} {'filler ' * 90}", "en", "s"),
    ]
    got = sorted((r["doc_id"], r["verbatim"]) for r in decontam.find(frame(spark, docs), items(spark, item)).collect())
    assert got == [(1, True), (2, False), (3, False), (4, False)]
    assert {r["doc_id"] for r in decontam.keep_clean(frame(spark, docs), items(spark, item)).collect()} == {5, 6}


def slow_words(text):
    """(word, forms of it, literal in each form?) by the rules of the docstring."""
    out, last_end, prev = [], 0, None
    for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text):
        w, low = m[0], re.sub("[A-Z]", lambda c: c[0].lower(), m[0])
        opens = prev is None or bool(re.search(r"[.!?:\n]", text[last_end : m.start()]))
        number = w[0] in "0123456789" or low in decontam.NUMBER_WORDS
        capital = not number and w[0] in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" and not (len(w) > 1 and w[1] in "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        unit = prev and not number and low in decontam.UNITS
        kinds = []
        for name in (capital and not opens, False, capital):
            kinds.append("<unit>" if unit else "<name>" if name else "<number>" if number else low)
        out.append((str(decontam.NUMBER_WORDS.get(low, low)), kinds, [k[0] != "<" for k in kinds]))
        last_end, prev = m.end(), number
    return out


def slow_find(docs, items, coverage=decontam.COVERAGE):
    """All pairs of windows compared word by word; the verdict on them is the operator's."""
    out = []
    for item_id, item in items:
        index = decontam.ItemIndex([item_id], [item])
        iw = slow_words(item or "")
        for doc_id, text, *_ in docs:
            dw, found = slow_words(text or ""), set()
            lengths = {5: (0, 1, 2), len(iw): ()} if len(iw) < 5 else {5: (0, 1, 2)}
            met = {j for j in range(len(iw) - 4) if sum(w[2][0] for w in iw[j : j + 5]) >= 3}
            sparse = len({j + k for j in met for k in range(5)}) < coverage * len(iw)
            for n, forms in lengths.items():
                for i in range(len(dw) - n + 1 if n else 0):
                    for j in range(len(iw) - n + 1):
                        a, b = dw[i : i + n], iw[j : j + n]
                        hit = any([x[1][f] for x in a] == [x[1][f] for x in b] and sum(x[2][f] for x in b) >= 3 for f in forms)
                        if not hit and (sparse or n < 5):
                            hit = [x[0] for x in a] == [x[0] for x in b] or n == 5 and [x[1][0] for x in a] == [x[1][0] for x in b] and 0 < sum(x[2][0] for x in b) < 3
                        if hit:
                            found.add((i, j, n))
            if found:
                mine, theirs, length = (np.array(x) for x in zip(*sorted(found), strict=True))
                value = decontam._read(*bytekit.buffers(pa.array([text])))[1]
                verdict = decontam._judge(index, value, mine, theirs, length, 0, coverage)
                if verdict:
                    out.append((doc_id, item_id, round(verdict[0], 9), verdict[1], verdict[2]))
    return sorted(out, key=str)


QUESTIONS = [
    "A train leaves {c} at {n} and travels {m} miles to {d}. How many hours does the train need at {k} miles per hour?",
    "{c} has {n} apples. {d} gives {c} {m} more apples and eats {k} of them. How many apples are left for {c}?",
    "If {c} paid {n} dollars and {d} paid {m} dollars, how much did the two friends spend on the {k} books?",
    "A tank holds {n} liters of water and loses {m} liters every hour. After how many hours is it empty if {c} adds {k} liters?",
    "The price of a coat rose from {n} dollars to {m} dollars in a shop of {c}. By what percent did the price rise?",
    "{c} runs {n} km in {m} minutes. What is the speed of {c} in km per hour when {d} rides {k} km behind?",
]
PEOPLE = "Alice Bob Carol Dave Erin Frank Grace Heidi Ivan Judy Boston Denver Albany Tulsa Paris Madrid Lyon Porto".split()


def filled(rng, question):
    c, d = rng.sample(PEOPLE, 2)
    return question.format(c=c, d=d, n=rng.randrange(2, 99), m=rng.randrange(100, 999), k=rng.randrange(1000, 5000))


def planted(n=240, seed=3):
    """(documents, items, the pairs planted): re-parameterised copies, in lower case, in title case, in the middle of a text."""
    rng = random.Random(seed)
    items = [(i, filled(rng, q)) for i, q in enumerate(QUESTIONS)]
    docs, truth = [], set()
    for i in range(n):
        t = words(rng, 40)
        if i % 3:
            k = rng.randrange(len(items))
            copy = items[k][1] if i % 5 == 0 else filled(rng, QUESTIONS[k])
            copy = copy.lower() if i % 7 == 0 else copy.title() if i % 11 == 0 else copy
            t += rng.choice((" ", "\n", ". ")) + copy + " " + words(rng, 20)
            truth.add((i, k))
        docs.append((i, t, "en", "s"))
    return docs, items, truth


def test_recall_of_changed_questions(spark):
    docs, some, truth = planted()
    found = decontam.find(frame(spark, docs), spark.createDataFrame(some, "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    assert got <= truth and len(got) >= 0.9 * len(truth), (len(got), len(truth))


def test_find_against_brute_force(spark):
    docs, some, _ = planted(60, 5)
    some += [(90, "seven plus four"), (91, "John Smith paid 12 dollars and Mary Jones paid 15 dollars"), (92, ""), (93, some[0][1])]
    docs += [(200, "John Smith paid 12 dollars and Mary Jones paid 15 dollars", "en", "s"), (201, "so Seven plus four!", "en", "s"), (202, "Ann paid 12 dollars and Ann paid 15 dollars", "en", "s"), *NASTY[:20]]
    found = decontam.find(frame(spark, docs), spark.createDataFrame(some, "item_id long, text string"))
    got = sorted(((r["doc_id"], r["item_id"], round(r["covered"], 9), r["word"], r["verbatim"]) for r in found.collect()), key=str)
    assert got == slow_find(docs, some)


def test_windows_that_many_items_share(spark):
    """Passive windows lose no match."""
    rng = random.Random(6)
    some = [(i, f"Please read the text and answer the question about {words(rng, 8, 50)} with a short phrase of one or two words") for i in range(60)]
    some += [(100, "Please read the text and answer the question about it")]
    docs = [(i, words(rng, 20) + " " + some[i % 61][1] + " " + words(rng, 20), "en", "s") for i in range(70)] + [(99, "Please read the text and answer the question about", "en", "s")]
    found = decontam.find(frame(spark, docs), spark.createDataFrame(some, "item_id long, text string")).collect()
    index = decontam.ItemIndex(*zip(*some, strict=True))
    assert any(passive for *_, passive in index.lookups)
    got = sorted((r["doc_id"], r["item_id"], round(r["covered"], 9), r["word"], r["verbatim"]) for r in found)
    assert {(i, some[i % 61][0]) for i in range(70)} <= {r[:2] for r in got}
    assert got == sorted(slow_find(docs, some))


def test_same_names_are_no_different_names(spark):
    item = "Now John sold 12 books to Mary and Mary gave 3 of the books to John for free"
    docs = [(1, item.replace("John", "Ann").replace("Mary", "Eve"), "en", "s"), (2, item.replace("John", "Ann").replace("Mary", "Ann"), "en", "s"), (3, item.replace("12", "3"), "en", "s")]
    assert sorted(r["doc_id"] for r in decontam.find(frame(spark, docs), items(spark, item)).collect()) == [1, 3]
