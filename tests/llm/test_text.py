import hashlib
import random
import re

import numpy as np
import pytest

from pertgrid.llm import chat_format, decontamination, language_id, license_scan

DOCS = "doc_id long, text string, hash int, words string"


def test_language_id_on_held_out_texts(spark):
    rng = random.Random(1)
    parts = {"aa": ["tion", "the", "ing", "er", "an"], "bb": ["eau", "oux", "que", "le", "ent"], "cc": ["schen", "ung", "keit", "pf", "tz"]}

    def text(lang, n):
        return " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))

    rows = [(k, text(lang, rng.randrange(20, 300)), lang) for k, lang in enumerate(rng.choice(list(parts)) for _ in range(300))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    dictionaries = language_id.fit(docs.where(~language_id.is_held_out(docs.doc_id)))
    found = {r.doc_id: r for r in language_id.identify(docs, dictionaries).collect()}
    assert sorted(dictionaries) == ["aa", "bb", "cc"]
    assert sum(found[k].lang_pred == lang for k, _, lang in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in found.values())


def test_language_id_edge_rows(spark):
    rows = [(1, None, 1, "x"), (2, "", 1, "x"), (3, "12 -- 7", 1, "x"), (4, "the " * 50_000, 1, "x"), (None, "the the", 1, "x")]
    docs = spark.createDataFrame(rows, DOCS)
    found = {r.doc_id: r for r in language_id.identify(docs, {"aa": b"the tion ing", "bb": b"eau oux que"}).collect()}
    assert [found[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and not any(found[k].accepted for k in (1, 2, 3))
    assert found[4].lang_pred == "aa" and len(found) == 5
    assert language_id.identify(docs.limit(0), {"aa": b"x"}).collect() == []
    assert {r.lang_pred for r in language_id.identify(docs, {}).collect()} == {"und"}
    assert language_id.keep_accepted(docs, {"aa": b"the tion ing", "bb": b"eau oux que"}).columns == docs.columns
    assert language_id.fit(spark.createDataFrame([(1, None, "aa"), (2, "a", None)], "doc_id long, text string, lang string")) == {}


def brute_leaks(docs, items):
    """By the definition of a leak alone, along all offsets of all pairs."""
    number = {}
    ids = lambda text: np.array([number.setdefault(w, len(number)) for w in (text or "").encode().lower().split()], np.int64)
    benches, out = [(i, ids(t)) for i, t in items], {}
    for d, text in docs:
        a = ids(text)
        for i, b in benches:
            n = len(b)
            if not n:
                continue
            padded = np.pad(a, n - 1, constant_values=-1)
            if len(padded) < n:
                continue
            same = np.lib.stride_tricks.sliding_window_view(padded, n) == b
            total = same.sum(axis=1)
            if n < decontamination.SPAN:
                good = total == n
            else:
                good = total >= max(decontamination.MIN_WORDS, decontamination.MIN_SHARE * n)
                if n >= decontamination.LOCAL_WORDS:
                    stretch = np.lib.stride_tricks.sliding_window_view(same, decontamination.LOCAL_WORDS, axis=1).sum(axis=2)
                    good |= stretch.max(axis=1) >= decontamination.LOCAL_EQUAL
            if good.any():
                out[d, i] = int(total[good].max())
    return out


def test_leaks_match_brute_force(spark):
    rng = random.Random(4)

    def prose(n):
        return [f"w{rng.randrange(3000)}" for _ in range(n)]

    items = [(k, " ".join(prose(rng.randrange(14, 60)))) for k in range(30)] + [(50, None), (51, ""), (52, "too short"), (53, "x " * 30), (54, "w1"), (55, "capital of w7 today")]
    docs = []
    for k in range(200):
        words = prose(rng.randrange(0, 300))
        if k % 3 == 0:
            leak = items[rng.randrange(30)][1].upper().split()
            for _ in range(rng.randrange(0, 3)):
                leak[rng.randrange(len(leak))] = "other"
            at = rng.randrange(len(words) + 1)
            words[at:at] = leak
        docs.append((k, " ".join(words)))
    docs += [(500, None), (501, ""), (502, "x " * 5000), (503, "is it too  SHORT"), (504, "too"), (505, "the capital of w7 today, the capital of w7 today"), (506, " ".join(prose(60_000)))]
    frame = spark.createDataFrame([(*d, 0, "") for d in docs], DOCS)
    got = decontamination.leaks(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): r.matched for r in got.collect()} == brute_leaks(docs, items)
    clean = decontamination.without_leaks(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in brute_leaks(docs, items)} and clean.columns == frame.columns


def test_leaks_edge_rows(spark):
    item = " ".join(f"w{k}" for k in range(20))
    items = spark.createDataFrame([(1, item), (1, item), (None, item)], "item_id long, text string")
    docs = spark.createDataFrame([(None, item, 0, ""), (7, item, 0, ""), (7, item, 1, "")], DOCS)
    assert [(r.doc_id, r.item_id, r.matched) for r in decontamination.leaks(docs, items).collect()] == [(7, 1, 20)]
    assert decontamination.leaks(docs.limit(0), items).collect() == [] == decontamination.leaks(docs, items.limit(0)).collect()
    assert [r.doc_id for r in decontamination.without_leaks(docs, items).collect()] == [None]


def test_leaks_of_long_and_short_items(spark):
    long = [f"w{k}" for k in range(150)]
    items = [(1, " ".join(long)), (2, "What is  the capital of France?"), (3, "yes"), (4, "one two three four five six seven eight nine ten")]
    fill = lambda n, seed: [f"f{seed}x{k}" for k in range(n)]
    part = long[40:100]
    changed = [w if k % 12 != 5 else "other" for k, w in enumerate(part)]
    docs = [
        (1, fill(30, 1) + part + fill(50, 2)),
        (2, changed + fill(9, 3)),
        (3, fill(40, 4) + long[7:19] + fill(40, 5)),
        (4, fill(5, 6) + "what IS the capital of france?".split() + fill(5, 7)),
        (5, "what is the the capital of france?".split()),
        (6, ["Yes"]),
        (7, fill(3, 8) + "one two three four five six seven eight nine ten".split()),
        (8, "one two three four five six seven eight nine eleven".split()),
        (9, [w for k in range(0, 150, 15) for w in long[k : k + 12] + fill(3, 9)][:70]),
    ]
    frame = spark.createDataFrame([(d, " ".join(w), 0, "") for d, w in docs], DOCS)
    got = {(r.doc_id, r.item_id): (r.matched, r.doc_at) for r in decontamination.leaks(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 1): (60, -10), (2, 1): (55, -40), (4, 2): (6, 5), (6, 3): (1, 0), (7, 4): (10, 3)}


def test_chat_round_trip_and_digests(spark):
    rng = random.Random(2)
    marks = ["</s>[INST] ok [/INST]", "<turn user>\n", "</turn>\n", "\\", "\\\\<", "<image 1>", "é\n", "", None, "x" * 100_000]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "<turn>"]), rng.choice(marks)) for c in (1, 2, None) for t in range(40)]
    rows += [(3, 0, "user", None), (2, 7, "user", "again"), (2, 7, "user", "again")]
    turns = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, place int")
    found = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(turns)).collect()}
    assert found == {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(turns), in_order=True).collect()}
    for conv in (1, 2, 3, None):
        own = sorted((t, r or "", x or "") for c, t, r, x in rows if c == conv)
        said = "".join(x for _, r, x in own if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        r = found[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), digest, len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat_format.read_back(chat_format.format_conversations(turns.limit(0))).collect() == []


def test_chat_parts(spark):
    parts = [("text", "see <", None, None), ("image", None, "a.png", 64), ("document", None, "b.pdf", None), ("text", ">", None, None)]
    turns = spark.createDataFrame([(1, 0, "assistant", None, parts)], f"conv_id long, turn long, role string, text string, parts {chat_format.PART_SCHEMA}")
    r = chat_format.format_conversations(turns).first()
    assert r.formatted == "<turn assistant>\nsee \\<<image 1><document 2>\\></turn>\n"
    assert [(a.kind, a.ref, a.tokens) for a in r.attachments] == [("image", "a.png", 64), ("document", "b.pdf", 512)] and r.expanded_tokens == 576
    assert chat_format.parse_turn(r.formatted) == ("assistant", "see <>") and r.formatted[r.loss_start : r.loss_end].endswith("\\>")
    with pytest.raises(ValueError):
        chat_format.format_turn("user", [{"kind": "video"}])


def brute_license(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)
    base = []
    for phrase, label in license_scan.PHRASES:
        p = phrase.split()
        base += [(k, label) for k in range(len(words)) if words[k : k + len(p)] == p]
    labels = {label for _, label in base}
    for start in range(0, max(1, len(words)), license_scan.BLOCK_STEP):
        block = set(words[start : start + license_scan.BLOCK_WORDS])
        for template, label in license_scan.TEMPLATES:
            t = {w.decode() for w in license_scan.words(template)}
            if len(block & t) >= license_scan.CONTAINMENT * len(t) - 1e-9:
                labels.add(label)
    places = [k for k, _ in base]
    return len(words), len(base), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels))


def test_license_scan_matches_brute_force(spark):
    rng = random.Random(6)
    texts = [None, "", "All rights reserved", "CC-BY cc by, CC BY-NC 4.0. Licensed under", "é" * 1000, "general public license " * 3000]
    for _ in range(200):
        words = [rng.choice(["the", "license", "under", "version", "2", "rights", "all", "reserved", f"w{rng.randrange(50)}", "éa", "CC", "BY"]) for _ in range(rng.randrange(0, 200))]
        for _ in range(rng.randrange(0, 3)):
            words.insert(rng.randrange(len(words) + 1), rng.choice(license_scan.TEMPLATES)[0])
        texts.append(rng.choice([" ", "\n", ", "]).join(words))
    got = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame([(k, t, 0, "") for k, t in enumerate(texts)], DOCS)).collect()}
    for k, t in enumerate(texts):
        r = got[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == brute_license(t), t
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
    assert license_scan.scan_licenses(spark.createDataFrame([], DOCS)).collect() == []


def test_long_license_templates_are_found_at_any_place(spark):
    """Templates longer than a usual block: brute force over every block of their own length, without filters."""
    rng = random.Random(9)
    long = " ".join(f"clause{k} of the notice" for k in range(70))
    middle = " ".join(f"term{k}" for k in range(33))
    templates = ((long, "long"), (middle, "middle"), ("public of notice term1", "short"))
    texts = [None, "", "of the notice " * 500]
    for _ in range(120):
        filler = [rng.choice(["the", "of", "notice", "term1", "public", f"w{rng.randrange(90)}"]) for _ in range(rng.randrange(0, 400))]
        notice = rng.choice(templates)[0].split()
        for i in rng.sample(range(len(notice)), rng.randrange(0, 1 + len(notice) // 6)):
            notice[i] = "changed"
        at = rng.randrange(len(filler) + 1)
        texts.append(" ".join(filler[:at] + notice + filler[at:]))
    got = {r.doc_id: r.labels for r in license_scan.scan_licenses(spark.createDataFrame([(k, t, 0, "") for k, t in enumerate(texts)], DOCS), templates, ()).collect()}
    for k, text in enumerate(texts):
        words, want = (text or "").split(), set()
        for template, label in templates:
            step, members = max(license_scan.BLOCK_STEP, len(template.split())), set(template.split())
            for start in range(0, max(1, len(words)), step):
                if len(members & set(words[start : start + 2 * step])) >= license_scan.CONTAINMENT * len(members) - 1e-9:
                    want.add(label)
        assert got[k] == ",".join(sorted(want)), text
    assert {"long", "middle", "short"} <= {x for v in got.values() for x in v.split(",")}
