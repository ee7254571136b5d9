"""The corpus operators against brute force, round trips and held-out accuracy."""

import random
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyflow.llm import avi_mjpeg, common, components, context_mixing, langid, line_quality, packing, simhash, source_mix, token_prefix, toxicity_fm, warc
from keyflow.llm.word_tokens import ChunkEncoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row_no long"
VOCABULARY = token_prefix.vocabulary()
SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, 0.0, 0) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with results."""
    long = " ".join(random.Random(3).choices(["alpha", "beta", "gamma", "Ωmega", "don't", "<|endoftext|>", "x" * 30], k=60_000))
    rows = [(1, "The cat sat.\n\nThe cat sat.", "en", "a"), (1, "The cat sat.\n\nThe cat sat.", "en", "a"), (2, None, None, None), (3, "", "en", "a"), (None, "null id", "en", "b"), (4, long, "en", "a"), (5, "  \t\n ", "de", "b"), (6, "naïve café ÉTÉ 北京 ② é \x00\xa0x", "fr", "b")]
    return frame(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def sf(spark):
    return common.table(spark, SF, "documents")


def union_find(fps, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= 4:
                p, q = find(ids[a]), find(ids[b])
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


# -- 1 --------------------------------------------------------------------------------------------------------------


def test_language_held_out(spark):
    found = langid.query(spark, "/root/testdata/sf0.01").join(common.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = found.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right / n > 0.95


def test_language_backs_off():
    known = {0: {"word": [(0, 4.0)]}, 1: {"z": [(1, 3.0)]}, 2: {"xy": [(0, 1.0), (1, 2.0)], "yz": [(0, 3.0)]}, 3: {}, 4: {}, 5: {}}
    model = langid.Model(["a", "b"], [-0.7, -0.7], {n: [-5.0, -6.0] for n in range(6)}, known)
    assert model.word("word") == [-1.0, -6.0] and model.word("xyz") == [-3.0, -5.0] and model.word("zz") == [-5.0, -3.0] and model.word("q") == [0.0, 0.0]


def test_language_scores_by_brute_force(spark, sf):
    """Log frequencies from plain counts, and each word of each text by itself."""
    from collections import Counter, defaultdict
    from math import exp, log

    rows = [(r.doc_id, r.text or "", r.lang) for r in sf.collect()]
    learnt = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 4 != 2 and x[2]]
    langs = sorted({x[2] for x in learnt})
    counts, docs = defaultdict(Counter), Counter()
    words = lambda t: ["".join(g) for k, g in __import__("itertools").groupby(t.lower(), lambda c: __import__("unicodedata").category(c)[0] == "L") if k]
    for _, text, lang in learnt:
        for w in words(text):
            counts[lang, 0][w] += 1
            for n in range(1, 6):
                counts[lang, n].update(langid.grams(w, n))
        docs.update((lang, w) for w in set(words(text)))
    drawn = Counter(x[2] for x in learnt)
    known = {0: {w for (lang, w), k in docs.items() if k >= max(2, drawn[lang] * 1e-3)}}
    known |= {n: {g for lang in langs for g, k in counts[lang, n].items() if k >= max(3, sum(counts[lang, n].values()) * 1e-5)} for n in range(1, 6)}
    size = {k: sum(c.values()) + 0.5 * len(c) + 1 for k, c in counts.items()}

    def word(w):
        for n in (0, 5, 4, 3, 2, 1):
            if hits := [g for g in (langid.grams(w, n) if n else [w]) if g in known[n]]:
                return [sum(log((counts[lang, n][g] + 0.5) / size[lang, n]) for g in hits) / len(hits) for lang in langs]
        return [0.0] * len(langs)

    found = {r.doc_id: r for r in langid.query(spark, SF).collect()}
    for i, text, _ in rows:
        if not words(text):
            assert (found[i].lang_pred, found[i].score) == ("und", 0.0)
            continue
        total = [log(drawn[lang] / len(learnt)) + sum(x) for lang, x in zip(langs, zip(*map(word, words(text))))]
        best = max(total)
        assert found[i].lang_pred == langs[total.index(best)] and found[i].score == pytest.approx(1 / sum(exp(x - best) for x in total), rel=1e-6)


def test_six_hundred_languages(spark):
    """No language is dropped."""
    rows = [(k, f"common lang{'abcdefghij'[k // 100]}{'abcdefghij'[k // 10 % 10]}{'abcdefghij'[k % 10]}x " * 4, f"l{k:03d}", None) for k in range(600)] 
    docs = frame(spark, rows + [(1000 + i, *r) for i, *r in rows])
    found = langid.predict(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id")
    assert found.where("lang = lang_pred").count() == 1200


def test_numerals_are_no_letters(spark):
    docs = frame(spark, [(1, "the cat", "en", None), (2, "² ½ ① Ⅷ 7", None, None), (3, "x²y", None, None)])
    found = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert (found[2].lang_pred, found[2].score) == ("und", 0.0) and found[3].lang_pred == "en"


def test_language_odd(spark, odd, none):
    model = langid.fit(odd)
    found = [(r.doc_id, r.lang_pred, r.score) for r in langid.predict(odd, model).collect()]
    assert len(found) == 8 and {p for i, p, _ in found if i in (2, 3, 5)} == {"und"} and all(0 <= s <= 1 for *_, s in found)
    assert langid.predict(odd, langid.fit(none)).where("lang_pred <> 'und'").count() == 0
    assert langid.predict(none, model).count() == 0


# -- 2 --------------------------------------------------------------------------------------------------------------


def slow_fingerprint(text):
    from xxhash import xxh64_intdigest

    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash_against_all_pairs(spark, sf):
    rows = sf.select("doc_id", "text").collect()
    fps = [slow_fingerprint(r.text) for r in rows]
    classes = union_find(fps, [r.doc_id for r in rows])
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.query(spark, SF).collect()}
    assert found == {r.doc_id: (f"{f:016x}", classes[r.doc_id]) for r, f in zip(rows, fps)}


def test_fingerprint_links_keep_every_class(spark, monkeypatch):
    monkeypatch.setattr(simhash, "_LONG", 20)  # so that lists are indexed again
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for base in list(fps)[:3]:
        for _ in range(60):
            x = base
            for b in rng.sample(range(64), rng.randint(1, 6)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    index = {f: k for k, f in enumerate(signed)}
    edges = spark.createDataFrame([(index[r.a], index[r.b]) for r in links.collect()], "a long, b long")
    got = {k: k for k in range(len(fps))} | {r.node: r.component for r in components.components(edges).collect()}
    assert got == union_find(fps, list(range(len(fps))))


def test_tally_gives_each_pair_one_list():
    """Of the lists in which a pair meets, one retains it, if and only if it shares four positional bytes."""
    import numpy as np

    rng = random.Random(8)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 8)):
            b ^= 1 << bit
        shared = [p for p in range(8) if (a ^ b) >> 8 * p & 255 == 0]
        differ = np.full(len(simhash.POSITIONS), a ^ b, np.uint64)
        retained = np.flatnonzero(simhash._similar(differ, np.arange(len(simhash.POSITIONS)))).tolist()
        similar = bin(a ^ b).count("1") <= 4
        assert len(retained) == similar and all(set(simhash.POSITIONS[k]) <= set(shared) for k in retained)


def test_simhash_odd(spark, odd, none):
    found = simhash.near_duplicates(odd).collect()
    assert len(found) == 8 and {r.component_id for r in found if r.doc_id in (2, 3, 5)} == {2}
    assert simhash.near_duplicates(none).count() == 0
    stays = simhash.one_row_of_each(odd)
    assert stays.columns == odd.columns and sorted((r.doc_id for r in stays.collect()), key=str) == [1, 2, 4, 6, None]


# -- 3 --------------------------------------------------------------------------------------------------------------


def test_lines_removed_and_documents_rejected(spark):
    banner = "Accept all cookies to read on with this fine site today"
    own = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    rows = [(k, f"{banner}\n{own(k)}", "en", "h") for k in range(30)]
    rows += [(100 + k, f"{banner}\n{banner.upper()}\nz{k}", "en", "h") for k in range(5)] + [(200 + k, banner + "\n" + own(7), "en", "g") for k in range(30)]
    found = {r.doc_id: r for r in line_quality.verdicts(frame(spark, rows), broadcast_lines=0).collect()}
    assert all(found[k].kept for k in range(30)) and not any(found[100 + k].kept for k in range(5))
    assert all(found[200 + k].kept for k in range(30))  # exact copies count once
    assert found[0].words_left == 51 and found[1].words_left == 40 and found[100].words_left == 1


def test_line_limits(spark):
    """Copies count on demand, the first text is spared or not, and the limit stops rising with the host."""
    banner, own = "Accept all cookies to read on with this fine site today", lambda k: " ".join(f"w{k}x{j}" for j in range(4))
    rows = [(k, f"{banner}\n{own(k % 3)}", "en", "h") for k in range(30)]
    kept = lambda df: {r.doc_id for r in df.where("kept").collect()}
    docs = frame(spark, rows)
    assert kept(line_quality.verdicts(docs, least_limit=5)) == set(range(30))
    assert kept(line_quality.verdicts(docs, least_limit=5, least_kept=0.5, count_copies=True)) == set(range(0, 30, 3))
    assert kept(line_quality.verdicts(docs, least_limit=2, least_kept=0.5, keep_first=False)) == set()
    many = frame(spark, [(k, f"{banner}\n{own(k)}", "en", "h") for k in range(60)])
    assert kept(line_quality.verdicts(many, least_limit=1, limit_share=1.0, least_kept=0.5)) == set(range(60))
    assert kept(line_quality.verdicts(many, least_limit=1, limit_share=1.0, least_kept=0.5, most_limit=50)) == {0}


def test_line_quality_odd(spark, odd, none):
    found = {r.doc_id: r for r in line_quality.verdicts(odd).collect()}
    assert found[2].n_words == 0 and found[2].base_failed and found[1].n_dup_lines == 1 and found[1].word_chars == 20 and found[6].n_words == 7
    assert found[4].n_words == 60_000 and line_quality.verdicts(none).count() == 0


# -- 4 --------------------------------------------------------------------------------------------------------------


def test_context_mixing_base_and_model(spark, sf):
    from collections import Counter
    from math import log10

    texts = {r.doc_id: [*(r.text or "").encode().lower().split(), None] for r in sf.select("doc_id", "text").collect()}
    counts = Counter(w for i, ws in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for r in context_mixing.query(spark, SF).collect():
        ws = texts[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) and (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert abs(r.base_score - sum(log10((counts[w] + 1) / (n + v + 1)) for w in ws)) < 1e-6
        assert -8 * len(b" ".join(w or b"x" for w in ws)) * 0.302 < r.score < 0


def slow_slot(context, before, k):
    """The table's place, in whole numbers."""
    most, bits = (1 << 64) - 1, (*context_mixing.REST_BITS, *context_mixing.HEAD_BITS)[k]
    h = (context + k + 1) * 0x9E3779B97F4A7C15 & most
    h ^= h >> 31
    return (((h ^ (before * 0xD6E8FEB86659FD93 & most)) * 0xFF51AFD7ED558CCD & most) >> (64 - bits)) + context_mixing.OFFSETS[k]


def slow_matches(text):
    """Of each unit: None, or the kind of match that is asked for and whether it holds."""
    cm, seen, run, out = context_mixing, {}, 0, [None]
    units = [cm.START, *text.encode().lower().split(), cm.END]
    for t in range(2, len(units)):
        last = seen.get((units[t - 2], units[t - 1]))
        holds = last == units[t]
        out.append(None if last is None else (min(7, (run + 1).bit_length() - 1), holds))
        run = run + 1 if holds else 0
        seen[units[t - 2], units[t - 1]] = units[t]
    return out


def slow_bits(text, skip=False):
    """Of each bit of a text: the side, the bits before it in its byte, the bit, table places, and the exact context;
    with `skip`, units whose match holds are left out."""
    cm = context_mixing
    units = [*text.encode().lower().split(), cm.END]
    for last, unit, match in zip([cm.START, *units], units, slow_matches(text)):
        if skip and match and match[1]:
            continue
        for place, byte in enumerate(unit if unit == cm.END else unit + b" "):
            before = 1
            for k in range(7, -1, -1):
                if place == 0:
                    yield 1, before, byte >> k & 1, [slow_slot(int.from_bytes(last[len(last) - min(n, len(last)) :], "little"), before, len(cm.REST) + j) for j, n in enumerate(cm.HEAD)], ("whole", last, before)
                else:
                    begin = unit[:place]
                    slots = [slow_slot(sum(b << 8 * i for i, b in enumerate(begin[::-1][:n])), before, j) for j, n in enumerate(cm.REST)]
                    yield 0, before, byte >> k & 1, slots, ("begin", begin, before) if cm.LEAST_BEGINNING <= place <= cm.MOST_BEGINNING else None
                before = before << 1 | byte >> k & 1


def slow_score(text, model, exact, rates):
    from math import exp, log, log10

    import numpy as np

    total, shown = 0.0, {}
    for kind, holds in filter(None, slow_matches(text)):
        h, n = shown.get(kind, (0, 0))
        p = (h + context_mixing.MATCH_WEIGHT * rates[kind]) / (n + context_mixing.MATCH_WEIGHT)
        total += log10(p if holds else 1 - p)
        shown[kind] = (h + holds, n + 1)
    for side, before, bit, slots, context in slow_bits(text, skip=True):
        pairs = [(float(model.tables[0][s]), float(model.tables[1][s])) for s in slots] + [exact.get(context, (0, 0))]
        kinds = [min(int(np.log2(z + o + 1)), 7) + 8 * (z == 0 or o == 0) for z, o in pairs]
        longest = max((k + 1 for k, kind in enumerate(kinds) if kind != 8), default=0)
        x = sum(float(model.weights[side][k][16 * longest + kind]) * log((o + 0.2) / (z + 0.2)) for k, (kind, (z, o)) in enumerate(zip(kinds, pairs)))
        x = max(-12.0, min(12.0, x))
        at = (x + 12) * 32 / 24
        low = min(int(at), 31)
        refined = model.refine[side][low][before] * (low + 1 - at) + model.refine[side][low + 1][before] * (at - low)
        p = min(max((1 / (1 + exp(-x)) + refined) / 2, 1e-6), 1 - 1e-6)
        total += log10(p if bit else 1 - p)
    return total


def test_context_mixing_bit_by_bit(spark, sf, monkeypatch):
    """A slow version that goes bit by bit over each text, with counts in a dictionary, agrees; parts cut words with equal beginnings."""
    monkeypatch.setattr(context_mixing, "PART_UNITS", 90)
    rng = random.Random(6)
    stems = ["tokenstokens" + "".join(rng.choices("abc", k=8)) for _ in range(300)]
    texts = [(r.doc_id, (r.text or "")[:1500]) for r in sf.select("doc_id", "text").limit(12).collect()]
    texts += [(1000 + k, " ".join(rng.choices(stems, k=60))) for k in range(20)] + [(2000, "z" * 70 + " " + "z" * 71), (2003, "one two three four five six " * 40), (2004, "one two three four five six " * 30 + "else " + "one two " * 300), (2001, "\x00a \x00 é" * 3), (2002, None)]
    docs = frame(spark, [(i, t, None, None) for i, t in texts])
    units = context_mixing.by_part(common.materialize(context_mixing.counted_units(context_mixing.postings(docs)), "test"))
    n_parts = units.agg(F.max("part")).first()[0] + 1
    assert n_parts > 3 and units.where("ghost").count() > 0
    model = context_mixing.fit(units, n_parts)
    exact, tables, asked, held = {}, {}, [0] * 8, [0] * 8
    for i, t in texts:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            for kind, holds in filter(None, slow_matches(t or "")):
                asked[kind], held[kind] = asked[kind] + 1, held[kind] + holds
        if zlib.crc32(str(i).encode()) % 7 != 2:
            for _, _, bit, slots, context in slow_bits(t or ""):
                for s in slots:
                    tables.setdefault(s, [0, 0])[bit] += 1
                if context:
                    exact.setdefault(context, [0, 0])[bit] += 1
    assert {s: [*model.tables[:, s]] for s in model.tables.any(0).nonzero()[0].tolist()} == tables
    rates = [(h + 0.5) / (n + 1) for n, h in zip(asked, held)]
    assert sum(held) > 50
    found = {r.doc_id: r for r in context_mixing.scores(docs).collect()}
    for i, t in texts:
        want = slow_score(t or "", model, exact, rates)
        assert found[i].score == pytest.approx(want, rel=1e-4, abs=1e-4)
        n_bytes = len(b" ".join((t or "").encode().split())) + 1 + bool((t or "").split())
        assert found[i].bits_per_byte == pytest.approx(-want * 3.3219281 / n_bytes, rel=1e-4)


def test_context_mixing_order_counts(spark):
    rng = random.Random(9)
    texts = [" ".join(x for _ in range(60) for x in (rng.choice("abcdef") * 3, rng.choice("uvwxyz") * 3)) for _ in range(40)]
    mixed = texts[0].split()
    rng.shuffle(mixed)
    docs = frame(spark, [(k, t, None, None) for k, t in enumerate([*texts, " ".join(mixed)])])
    found = {r.doc_id: r.score for r in context_mixing.scores(docs).collect()}
    assert found[40] < found[0] - 5


def test_context_mixing_odd(spark, odd, none):
    found = {r.doc_id: r for r in context_mixing.scores(odd).collect()}
    assert found[2].n_tokens == 1 and found[2].score == found[3].score and found[4].n_tokens == 60_001
    assert context_mixing.scores(odd).count() == 8 and context_mixing.scores(none).count() == 0


# -- 5 --------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("text", [b"", b"a", b"\xff" * 500, bytes(range(256)) * 40, b"\x6d\x6c" * 40_000])
def test_media_round_trip(text, monkeypatch):
    media = avi_mjpeg.store(text)
    monkeypatch.setattr(avi_mjpeg, "AT_A_TIME", 64)  # several steps
    assert avi_mjpeg.store(text) == media and avi_mjpeg.store_all([b"x", text])[1] == media
    payload, shares, step = avi_mjpeg.read_all([media])[0]
    assert payload == avi_mjpeg.padded(text) and len(payload) % 192 == 0 and len(avi_mjpeg.parse(media)["frames"]) == len(shares) and step == 40_000


class SlowBits:
    """A scan read bit by bit."""

    def __init__(self, data):
        self.bits = "".join(f"{b:08b}" for b in data)
        self.at = 0

    def take(self, n):
        self.at += n
        return int(self.bits[self.at - n : self.at] or "0", 2)

    def symbol(self, table):
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in table:
                return table[length, code]
        raise ValueError

    def value(self, size):
        v = self.take(size)
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


def slow_coefficients(head, scan):
    """Units of blocks of coefficients, one symbol after another."""
    parts, at = [bytearray()], 0
    while at < len(scan):
        if scan[at] == 0xFF and scan[at + 1] == 0:
            parts[-1].append(0xFF)
            at += 2
        elif scan[at] == 0xFF and 0xD0 <= scan[at + 1] <= 0xD7:
            parts.append(bytearray())
            at += 2
        else:
            parts[-1].append(scan[at])
            at += 1
    out, tables = [], [[avi_mjpeg.huffman(*t) for t in c["tables"]] for c in head["components"]]
    for u in range(head["across"] * head["down"]):
        if u == 0 or head["restart"] and u % head["restart"] == 0:
            bits, before = SlowBits(parts[u // head["restart"] if head["restart"] else 0]), [0] * len(tables)
        unit = []
        for k in head["blocks"]:
            before[k] += bits.value(bits.symbol(tables[k][0]))
            block, i = [before[k]] + [0] * 63, 1
            while i < 64:
                s = bits.symbol(tables[k][1])
                if s == 0:
                    break
                i += s >> 4
                if s & 15:
                    block[i] = bits.value(s & 15)
                i += 1
            unit.append(block)
        out.append(unit)
    return out


def coded(rng, width, height, sampling, restart, own_tables):
    """A frame of random sparse coefficients, and those."""
    seg = avi_mjpeg.segment
    tables = {0x00: avi_mjpeg.DC_LUMA, 0x10: avi_mjpeg.AC_LUMA, 0x01: avi_mjpeg.DC_CHROMA, 0x11: avi_mjpeg.AC_CHROMA}
    if own_tables:  # all symbols alike long
        symbols = bytes(sorted(avi_mjpeg.AC_LUMA[1]))
        tables[0x10] = (bytes([0] * 7 + [len(symbols)] + [0] * 8), symbols)
    comps = [(1, sampling, 0x00), (2, 0x11, 0x11), (3, 0x11, 0x11)]
    head = b"\xff\xd8" + seg(0xDB, b"\0" + bytes(rng.randint(1, 60) for _ in range(64)))
    head += seg(0xC0, (8).to_bytes(1) + height.to_bytes(2) + width.to_bytes(2) + b"\x03" + b"".join(bytes([i, h, 0]) for i, h, _ in comps))
    if own_tables:
        head += seg(0xC4, b"\x10" + tables[0x10][0] + tables[0x10][1])
    head += (seg(0xDD, restart.to_bytes(2)) if restart else b"") + seg(0xDA, b"\x03" + b"".join(bytes([i, t]) for i, _, t in comps) + b"\x00\x3f\x00")
    codes = {k: {v: key for key, v in avi_mjpeg.huffman(*t).items()} for k, t in tables.items()}
    h, v = sampling >> 4, sampling & 15
    units, blocks = -(-width // (8 * h)) * -(-height // (8 * v)), [0] * (h * v) + [1, 2]
    put = lambda k, s: f"{codes[k][s][1]:0{codes[k][s][0]}b}"
    extra = lambda x: f"{x if x > 0 else x + (1 << abs(x).bit_length()) - 1:0{abs(x).bit_length()}b}" if x else ""
    truth, parts, bits, before = [], [], "", [0, 0, 0]
    for u in range(units):
        if restart and u and u % restart == 0:
            parts.append(bits)
            bits, before = "", [0, 0, 0]
        truth.append([])
        for k in blocks:
            block = [rng.randint(-200, 200)] + [rng.randint(-90, 90) if rng.random() < 0.12 else 0 for _ in range(63)]
            truth[-1].append(block)
            d, before[k] = block[0] - before[k], block[0]
            bits += put(0x00 if k == 0 else 0x01, abs(d).bit_length()) + extra(d)
            t, run = 0x10 if k == 0 else 0x11, 0
            last = max((i for i in range(64) if block[i]), default=0)
            for i in range(1, last + 1):
                if block[i] == 0:
                    run += 1
                    continue
                while run > 15:
                    bits, run = bits + put(t, 0xF0), run - 16
                bits, run = bits + put(t, run << 4 | abs(block[i]).bit_length()) + extra(block[i]), 0
            if last < 63:
                bits += put(t, 0)
    scan = b""
    for k, part in enumerate([*parts, bits]):
        part += "1" * (-len(part) % 8)
        scan += (bytes([0xFF, 0xD0 + (k - 1) % 8]) if k else b"") + bytes(int(part[i : i + 8], 2) for i in range(0, len(part), 8)).replace(b"\xff", b"\xff\0")
    return head + scan + b"\xff\xd9", truth


@pytest.mark.parametrize("sampling, restart, own_tables", [(0x11, 0, False), (0x22, 0, True), (0x21, 3, False), (0x11, 1, True)])
def test_decoder_by_brute_force(sampling, restart, own_tables):
    """Frames of any tables, sampling and restart intervals against a decoder that goes bit by bit."""
    rng = random.Random(sampling + restart)
    made = [coded(rng, 37, 29, sampling, restart, own_tables) for _ in range(3)] + [coded(rng, 64, 8, sampling, restart, own_tables)]
    got = []
    for _, head, found in avi_mjpeg.decode([m[0] for m in made]):
        got += [x.tolist() for x in found]
        assert avi_mjpeg.planes(head, found, 0).shape[1] >= head["height"]
    for (frame, truth), found in zip(made, got):
        head_bytes = avi_mjpeg._head_of(frame)
        assert found == truth == slow_coefficients(avi_mjpeg.header(head_bytes), frame[len(head_bytes) : -2])


def test_inverse_transform():
    """Against the sum that defines it, in floats; a flat block is a flat plane."""
    import numpy as np

    head = {"components": [{"quant": np.ones(64, int), "h": 1, "v": 1}], "blocks": [0], "across": 1, "down": 1}
    zigzag = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    rng = np.random.default_rng(2)
    for block in [np.array([80] + [0] * 63), *rng.integers(-60, 60, (4, 64))]:
        c = lambda k: 0.5**0.5 if k == 0 else 1.0
        want = [[sum(block[i] * c(v) * c(u) / 4 * np.cos((2 * y + 1) * v * np.pi / 16) * np.cos((2 * x + 1) * u * np.pi / 16) for i, (v, u) in enumerate(zigzag)) for x in range(8)] for y in range(8)]
        found = avi_mjpeg.planes(head, block.reshape(1, 1, 1, 64), 0)[0].astype(int)
        assert np.abs(found - np.clip(np.array(want) + 128, 0, 255)).max() <= 0.6
    assert (avi_mjpeg.planes(head, np.array([80] + [0] * 63).reshape(1, 1, 1, 64), 0) == 138).all()


def test_shots():
    import numpy as np

    shares = np.zeros((12, 16))
    shares[:5, 3] = shares[5:10, 9] = shares[10:, 1] = 1
    found = avi_mjpeg.clips(shares, 40_000)
    assert [(a, b) for a, b, *_ in found] == [(0, 4), (5, 9), (10, 11)] and found[1][2] == 0.2
    # a shot that changes by half all the time is cut only where it changes by more
    uneasy = np.zeros((20, 16))
    uneasy[:, 0], uneasy[::2, 1], uneasy[1::2, 2] = 0.65, 0.35, 0.35
    uneasy[15:] = np.roll(uneasy[15:], 5, axis=1)
    assert [a for a, *_ in avi_mjpeg.clips(uneasy, 40_000)] == [0, 15]


def test_indexes_and_lists():
    """Nested lists without an index, and the two-level index of larger files, find the same frames."""
    import struct

    frames = avi_mjpeg.frames_of(bytes(range(256)) * 12)
    plain = avi_mjpeg.avi(frames)
    chunk = avi_mjpeg.chunk
    of = lambda m: [m[a:b] for a, b in avi_mjpeg.parse(m)["frames"]]
    nested = chunk(b"RIFF", b"AVI " + chunk(b"LIST", b"movi" + chunk(b"LIST", b"rec " + b"".join(chunk(b"00dc", f) for f in frames[:2])) + b"".join(chunk(b"00dc", f) for f in frames[2:])))
    assert of(plain) == of(nested) == frames
    half = len(frames) // 2
    strh, size = b"vidsMJPG" + bytes(48), 24 + 16 * 2

    def build(offsets):
        indx = struct.pack("<HBBI4s12x", 4, 0, 0, 2, b"00dc") + b"".join(struct.pack("<QII", o, 0, 0) for o in offsets)
        head = chunk(b"LIST", b"hdrl" + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"indx", indx)))
        out, places = b"", []
        for k, part in enumerate((frames[:half], frames[half:])):
            start, movi, entries = len(out) + 12 + (len(head) if k == 0 else 0) + 8 + 4, b"", []
            for f in part:
                entries.append((start + len(movi) + 8, len(f)))
                movi += chunk(b"00dc", f)
            places.append(start + len(movi))
            movi += chunk(b"ix00", struct.pack("<HBBI4sQI", 2, 0, 1, len(part), b"00dc", 0, 0) + b"".join(struct.pack("<II", *e) for e in entries))
            out += chunk(b"RIFF", (b"AVI " + head if k == 0 else b"AVIX") + chunk(b"LIST", b"movi" + movi))
        return out, places

    assert size == 56 and of(build(build([0, 0])[1])[0]) == frames


def test_media_null_and_broken(spark):
    good = avi_mjpeg.store(b"some text " * 300)
    rows = [(1, None), (2, b"no media"), (3, good[:-3000].replace(b"idx1", b"junk")), (4, good), (None, good)]
    found = avi_mjpeg.clip_rows(spark.createDataFrame(rows, "media_id long, media binary")).collect()
    assert {r.media_id: r.clip for r in found if r.error} .keys() <= {1, 2, 3} and {r.media_id for r in found if r.error} >= {1, 2}
    assert {r.media_id for r in found if r.clip == 0} >= {4, None}


def test_media_digests_by_brute_force(spark, sf):
    from hashlib import sha256

    some = sf.limit(60)
    found = {r.doc_id: r for r in avi_mjpeg.digests(some).collect()}
    for r in some.collect():
        raw = (r.text or "").encode()
        pad = raw + b" " * (192 - len(raw) % 192 if len(raw) % 192 or not raw else 0)
        media, x = avi_mjpeg.store(raw), found[r.doc_id]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), len(pad), sha256(pad).hexdigest(), zlib.crc32(pad[-16:]))
        assert (x.media_bytes, x.media_sha256) == (len(media), sha256(media).hexdigest())
        spans = [f"{a * 0.04:.2f}" for a in [c[0] for c in avi_mjpeg.shots(media)[0]]]
        assert x.feature.split(";")[0] == f"frames={-(-len(pad) // 768)}" and [c.split("-")[0] for c in x.feature.split("clips=")[1].split(",")] == spans


def test_media_odd(spark, odd, none):
    found = {r.doc_id: r for r in avi_mjpeg.digests(odd).collect()}
    assert found[2].n_bytes == 0 and found[2].payload_bytes == 192 and found[2].tail_crc32 == zlib.crc32(b" " * 16) and found[2].media_sha256 == found[3].media_sha256
    assert avi_mjpeg.digests(none).count() == 0 and avi_mjpeg.clip_rows(avi_mjpeg.stored_media(odd)).where("clip = 0").count() == 8


def test_media_of_a_long_text(spark):
    found = avi_mjpeg.digests(frame(spark, [(1, "long text, " * 900_000, None, None), (2, "b", None, None)])).orderBy("doc_id").first()
    assert found.n_bytes == 9_900_000 and found.payload_bytes == 9_900_096


# -- 6 --------------------------------------------------------------------------------------------------------------


def test_targets():
    assert source_mix.targets([("b", 100), ("a", 100), (None, 100)]) == pytest.approx({"a": 187.5, "b": 75, None: 37.5})
    capped = source_mix.targets([("a", 10), ("b", 1000), ("c", 1000)])
    assert capped["a"] == 30 and sum(capped.values()) == pytest.approx(2010)


def test_mix_near_targets(spark, sf, odd, none):
    found = source_mix.mix(sf).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max(F.col("taken") - 3 * F.col("size")).alias("over")).collect()
    assert all(abs(r.taken - r.target) <= 1 and r.over <= 0 for r in found)
    assert source_mix.mix(odd).count() == 8 and source_mix.mix(none).count() == 0


def test_mixed_documents_near_targets(spark, sf):
    """What the pipeline's stage gives, in whole documents: half a document off at most."""
    goals = {r.source: (r.target, r.most) for r in source_mix.mix(sf).groupBy("source").agg(F.first("target").alias("target"), F.max("size").alias("most")).collect()}
    mixed = source_mix.mixed_documents(sf)
    assert mixed.columns == sf.columns
    got = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(source_mix.word_count(F.col("text"))).alias("n")).collect()}
    assert all(abs(got.get(s, 0) - target) <= most / 2 + 1 for s, (target, most) in goals.items())


def test_schedule(spark):
    """All turns of all sources, tiny ones included, and each source close to its share in every run of slots."""
    counts = [(0, 5000), (1, 1), (2, 0), (3, 2500), (4, 2)]
    rows = sorted((r.slot, r.source_no, r.turn) for r in source_mix.schedule(spark, counts).collect())
    for no, n in counts:
        assert [t for _, s, t in rows if s == no] == list(range(n))
    assert len({slot for slot, *_ in rows}) == len(rows)
    for at in range(0, 7000, 500):
        assert abs(sum(s == 0 for _, s, _ in rows[at : at + 500]) - 500 * 5000 / 7503) < 8


def test_mix_by_brute_force(spark):
    """Words one by one, with null and repeated ids, repeated rows, ties, and a block that cuts documents."""
    rng = random.Random(12)
    rows = [(rng.choice([None, 1, 2, k]), " ".join("w" * rng.randint(0, 30)), None, rng.choice(["a", "a", "a", "b", "c", None, "ä"])) for k in range(150)] + [(1, "x y z", None, "b")] * 5 + [(None, None, None, "zz")]
    found = source_mix.mix(frame(spark, rows), block=7).collect()
    from hashlib import md5

    by = {}
    for i, t, _, s in rows:
        by.setdefault(s, []).append((md5(("" if i is None else str(i)).encode()).hexdigest(), i is not None, i or 0, md5((t or "").encode()).hexdigest(), len((t or "").split())))
    goals = source_mix.targets([(s, sum(x[-1] for x in d)) for s, d in by.items()])
    want = []
    for s, d in by.items():
        line = [k for k, x in enumerate(sorted(d)) for _ in range(x[-1])]
        took = [line[j % len(line)] for j in range(int(goals[s]))] if line else []
        want += [(s or "", x[2] if x[1] else None, x[-1], took.count(k)) for k, x in enumerate(sorted(d))]
    assert sorted(((r.source or "", r.doc_id, r.size, r.taken) for r in found), key=str) == sorted(want, key=str)


def test_mix_of_many_sources(spark):
    """5,000 sources, of which most are far smaller than a block."""
    rows = [(k, "one two three four", None, f"s{k:04d}") for k in range(4999)] + [(5000 + k, "word " * 300, None, "big") for k in range(200)]
    found = source_mix.mix(frame(spark, rows)).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert len(found) == 5000 and all(abs(r.taken - r.target) <= 1 for r in found)


# -- 7 --------------------------------------------------------------------------------------------------------------


def check_packing(rows, ids, most):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.start)
        at = 0
        for p in pieces:
            assert p.start == at and zlib.crc32(ids[i][4 * at : 4 * (at + p.length)]) == p.ids_crc32 and p.doc_tokens == len(ids[i]) // 4
            at += p.length
        assert 4 * at == len(ids[i])
    padding = 0
    for s in by_sequence.values():
        s.sort(key=lambda r: r.offset)
        n = sum(r.length for r in s)
        assert [r.offset for r in s] == [sum(x.length for x in s[:k]) for k in range(len(s))] and n <= most
        padding += 0 if n & (n - 1) == 0 else most - n
    return padding


def test_packing(spark, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    ids = {r.doc_id: b"".join(x.to_bytes(4, "little") for x in [*t.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in sf.select("doc_id", "text").collect()}
    assert check_packing(packing.query(spark, SF).collect(), ids, 4096) == 0


def test_packing_limits():
    rng = random.Random(1)
    pieces = [packing.Piece(k, b"\0\0\0\0" * n, 0, n, bytes(rng.random() < 0.5 for _ in range(n)) if k % 3 else None) for k, n in enumerate(rng.randint(1, 300) for _ in range(400))]
    done, left = packing.pack(pieces, 128, 3, 60, True)
    assert not left and sum(len(p) for s in done for p in s) == sum(map(len, pieces))
    for s in done:
        assert sum(map(len, s)) <= 128 and len(s) <= 3 and sum(p.loss() for p in s) <= 60


def test_piece_within_by_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(1, 20)
        p = packing.Piece(1, bytes(4 * n), 0, n, rng.choice([None, bytes(rng.random() < 0.6 for _ in range(n))]))
        for loss in range(6):
            want = max(m for m in range(1, n + 1) if p.cut(m)[0].loss() <= loss)
            assert p.within(loss) == want


def test_prompts_bear_no_loss(spark):
    docs = spark.createDataFrame([(1, "a b c d e", 3), (2, "f g", None), (3, "h", 50), (None, None, 1)], "doc_id long, text string, prompt int")
    found = {r.doc_id: r for r in packing.pack_documents(docs.coalesce(1), max_tokens=64, prompt_tokens="prompt").collect()}
    assert sum(r.loss_tokens for r in found.values()) <= 5 and found[3].loss_tokens == 0 and found[None].doc_tokens == 1


def test_conversations_bind_all_limits(spark, monkeypatch):
    """Every id once, answers alone bear loss, and none of the three limits is passed, though each is reached."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "TURNS", 5)
    turns = common.table(spark, SF, "conversations").unionByName(spark.createDataFrame([(10**6, t, "assistant" if t % 2 else None, None if t == 3 else "word " * 40) for t in range(12)], "conv_id long, turn long, role string, text string"))
    found = packing.pack_conversations(turns.coalesce(1), max_tokens=128, max_segments=3, max_loss=60).collect()
    t, total, bears = Tokenizer.from_file(VOCABULARY), {}, {}
    for r in turns.collect():
        n = len(t.encode(r.text or "", add_special_tokens=False).ids) + 1
        total[r.conv_id] = total.get(r.conv_id, 0) + n
        bears[r.conv_id] = bears.get(r.conv_id, 0) + n * (r.role == "assistant")
    got, sequences = {}, {}
    for r in found:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        sequences.setdefault(r.sequence_id, []).append(r)
    assert got == total and sum(r.loss_tokens for r in found) <= sum(bears.values())
    tokens, segments, loss = zip(*((sum(r.length for r in s), len(s), sum(r.loss_tokens for r in s)) for s in sequences.values()))
    assert max(tokens) == 128 and max(segments) == 3 and max(loss) == 60


def test_packing_odd(spark, odd, none):
    rows = packing.pack_documents(odd, VOCABULARY).collect()
    assert {r.doc_tokens for r in rows if r.doc_id in (2, 3, 5)} == {1} and packing.pack_documents(none, VOCABULARY).count() == 0


# -- 8 --------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("range_bytes", [700, 1 << 22])
def test_warc_round_trip(spark, tmp_path, range_bytes):
    rng = random.Random(2)
    big, noise = "same " * 400, "".join(chr(rng.randint(32, 1000)) for _ in range(3000))
    rows = [(k, f"http://h/{k} ü\n", t) for k, t in enumerate([big, "small", "small", None, "", noise, big, noise + "x", big])]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    found = {int(r.record_id[10:-1]): r for r in warc.read(spark, str(tmp_path / "w"), range_bytes).collect()}
    assert len(found) == 9 and bytes(found[8].payload).decode() == big and found[0].refers_to == found[6].refers_to == "<urn:page:8>"
    for k, _, t in rows:
        if found[k].record_type == "response":
            assert bytes(found[k].payload).decode() == (t or "")
    import gzip

    for path in (tmp_path / "w").glob("part-*"):
        assert gzip.decompress(path.read_bytes()).count(b"WARC/1.1") >= 1


def test_warc_false_magic(tmp_path):
    """Magic bytes inside a member aren't records."""
    inner = warc.member(warc.record(5, "u", b"inside", "d", None)) + b"\0"
    import gzip

    data = gzip.compress(warc.record(1, "u", b"\x1f\x8b\x08 no member" + inner[:20], "d", None), compresslevel=0) + gzip.compress(warc.record(2, "u", b"b", "d", None))
    (tmp_path / "x.gz").write_bytes(data)
    got = []
    for start in range(0, len(data), 50):
        with warc.opened(str(tmp_path / "x.gz")) as f:
            got += [head["warc-record-id"] for head, _ in warc.records(f, start, start + 50)]
    assert got == ["<urn:page:1>", "<urn:page:2>"]


def test_warc_large_member(spark, tmp_path):
    """A member of 16 MiB or more, and the empty one behind it, are one record."""
    noise = random.Random(3).randbytes(9 << 20).hex()
    warc.write(spark.createDataFrame([(1, "a", noise), (2, "b", "small")], "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"))
    for range_bytes in (1 << 20, 1 << 30):
        found = warc.read(spark, str(tmp_path / "w"), range_bytes).select("record_id", "record_type", F.octet_length("payload").alias("n")).collect()
        assert sorted(map(tuple, found)) == [("<urn:page:1>", "response", 18 << 20), ("<urn:page:2>", "response", 5)]


def test_warc_broken_members(spark, tmp_path):
    """Cut and damaged members are rows of their own; what lacks a record's headers is none."""
    import gzip

    whole = [gzip.compress(warc.record(k, "u", random.Random(k).randbytes(4000), "d", None)) for k in range(4)]
    damaged = bytearray(whole[1])
    damaged[-300:-200] = bytes(100)
    other = gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\n\r\nno id, no length")
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "x.gz").write_bytes(whole[0] + bytes(damaged) + other + gzip.compress(b"") + whole[2] + whole[3][:-700])
    for range_bytes in (100, 1 << 22):
        found = warc.read(spark, str(tmp_path / "w"), range_bytes).select("record_id", "record_type", F.octet_length("payload").alias("n")).collect()
        assert sorted(map(tuple, found), key=lambda x: x[0]) == [("<urn:page:0>", "response", 4000), ("<urn:page:1>", "broken", None), ("<urn:page:2>", "response", 4000), ("<urn:page:3>", "broken", None)]


def test_warc_odd_rows(spark, tmp_path):
    """Null and repeated ids, ties, columns with clashing names."""
    big = "ä" * 600
    rows = [(None, None, big, "x", "y"), (1, "u", big, None, None), (2, "u", big, "x", "y"), (2, "v", big, "x", "y"), (3, None, None, "x", "y"), (3, None, "", "x", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string, refers_to string")
    found = sorted((tuple(r) for r in warc.archived(pages).select("page_id", "payload_bytes", "record_type", "refers_to").collect()), key=str)
    assert found == sorted([(None, 1200, "revisit", 2), (1, 1200, "revisit", 2), (2, 1200, "response", None), (2, 1200, "response", None), (3, 0, "response", None), (3, 0, "response", None)], key=str)
    warc.write(pages, str(tmp_path / "w"), "2024-05-06T07:08:09Z")
    with warc.opened(str(next((tmp_path / "w").glob("part-*")))) as f:
        assert next(warc.records(f, 0, 1 << 30))[0]["warc-date"] == "2024-05-06T07:08:09Z"


def test_warc_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archived(pages).count() == 0


# -- 9 --------------------------------------------------------------------------------------------------------------


def test_token_counts_are_the_librarys(spark, sf, odd, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    for docs in (sf, odd):
        want = sorted(((r.doc_id or -1, len((r.text or "").encode()), len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.select("doc_id", "text").collect()))
        assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in token_prefix.token_counts(docs, VOCABULARY).collect()) == want
    assert token_prefix.token_counts(none, VOCABULARY).count() == 0


def test_prefix_tables():
    from tokenizers import Tokenizer

    t, encoder = Tokenizer.from_file(VOCABULARY), ChunkEncoder(VOCABULARY)
    for text in ("The café's naïve  résumé,\n<|endoftext|> éa x", "", "  ", "unbelievably"):
        want = [len(t.encode(text[:p], add_special_tokens=False).ids) for p in range(len(text) + 1)]
        table = token_prefix.PrefixTable(text, encoder)
        assert table.table() == want
        for budget in range(max(want) + 2):
            assert table.longest_within(budget) == max(p for p in range(len(text) + 1) if want[p] <= budget)


def test_prefix_tables_by_brute_force():
    from tokenizers import Tokenizer

    t, encoder, rng = Tokenizer.from_file(VOCABULARY), ChunkEncoder(VOCABULARY), random.Random(6)
    letters = "abcdefghijklmnop'<|>.,!?etsrdlmv012éüßñ北京が\u3099\u0323\u0301İΣ\u3000\xa0😀 \n"
    texts = ["!!<|endoftext|>'re", "x\u0338<|endoftext|>\u0338", *("".join(rng.choices(letters, k=rng.randint(1, 40))) for _ in range(300))]
    for text in texts:
        want = [len(t.encode(text[:p], add_special_tokens=False).ids) for p in range(len(text) + 1)]
        table = token_prefix.PrefixTable(text, encoder)
        assert table.table() == want and table.longest_within(5) == max(p for p, n in enumerate(want) if n <= 5)


def test_long_chunks_are_not_encoded_again(monkeypatch):
    """A text without white space: each pair of tokens is encoded once, not each prefix."""
    encoder = ChunkEncoder(VOCABULARY)
    monkeypatch.setattr(ChunkEncoder, "encode", lambda *_: pytest.fail("a prefix is encoded"))
    text = "".join(random.Random(7).choices("abcdefghijklmnopqrstuvwxyz0123456789+/北京", k=20_000))
    table = token_prefix.PrefixTable(text, encoder)
    assert table.total() == len(encoder.tokenizer.encode(text, add_special_tokens=False).ids) and table.counts[table.longest_within(900)] <= 900


# -- 10 -------------------------------------------------------------------------------------------------------------


def test_pairs_that_a_linear_model_misses(spark):
    """Toxic only when both words are there: each alone is harmless."""
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(600):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = rng.choices(["tree", "river", "stone", "cloud", "lamp"], k=6) + ["insult"] * a + ["group"] * b
        rng.shuffle(words)
        rows.append((k, " ".join(words), "en", "s"))
        labels.append((k, int(a and b)))
    docs = frame(spark, rows)
    model = toxicity_fm.fit(docs, spark.createDataFrame(labels[:400], "doc_id long, toxic int"))
    truth = dict(labels)
    found = [(truth[r.doc_id], r.predicted) for r in toxicity_fm.score(docs, model).where("doc_id >= 400").collect()]
    assert sum(a == b for a, b in found) / len(found) > 0.95


@pytest.mark.parametrize("rule", [lambda a, b: a == b, lambda a, b: a != b])
def test_pairs_without_effect_of_their_own(spark, rule):
    """Toxic with both or neither of two words, or with one of them: each word alone is as common in both classes."""
    rng = random.Random(5)
    rows, labels = [], []
    for k in range(900):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append((k, " ".join([*rng.choices(["tree", "river", "stone", "cloud", "lamp"], k=6)] + ["insult"] * a + ["group"] * b), "en", "s"))
        labels.append((k, int(rule(a, b))))
    docs = frame(spark, rows)
    model = toxicity_fm.fit(docs, spark.createDataFrame(labels[:600], "doc_id long, toxic int"))
    truth = dict(labels)
    found = [(truth[r.doc_id], r.score > 0.5) for r in toxicity_fm.score(docs, model).where("doc_id >= 600").collect()]
    assert sum(a == b for a, b in found) / len(found) > 0.95


def test_toxicity_scores_by_brute_force(spark, sf):
    """The sum over all pairs of buckets, one by one."""
    from itertools import combinations as pairs
    from math import exp

    import numpy as np

    rng = np.random.default_rng(3)
    model = toxicity_fm.blank(-0.4)
    model.w[:], model.v[:] = rng.normal(0, 0.2, model.w.shape), rng.normal(0, 0.1, model.v.shape)
    some = sf.limit(12)
    found = {r.doc_id: r.score for r in toxicity_fm.score(some, model).collect()}
    for r in some.collect():
        own = sorted({b for t in toxicity_fm._TERM.findall((r.text or "").encode().lower()) for b in toxicity_fm.term_buckets(t)})
        z = -0.4 + sum(0.5 * float(model.w[b]) for b in own) + sum(0.25 * float(model.v[a].astype(float) @ model.v[b]) for a, b in pairs(own, 2))
        assert found[r.doc_id] == pytest.approx(1 / (1 + exp(-max(-500, min(500, z)))), abs=1e-3)


def test_toxicity_odd(spark, odd, none):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    found = toxicity_fm.score(odd, toxicity_fm.fit(odd, empty)).collect()
    assert len(found) == 8 and all(0 <= r.score <= 1 for r in found) and toxicity_fm.score(none, toxicity_fm.fit(none, empty)).count() == 0


def test_toxicity_repeated_label_rows_count_once(spark):
    docs = [(k, "vile words here" if k % 2 else "kind words here", None, None) for k in range(40)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    once, often = (toxicity_fm.score(frame(spark, docs), toxicity_fm.fit(frame(spark, d), labels)).orderBy("doc_id").collect() for d in (docs, docs + docs[:1] * 500))
    assert [r.predicted for r in once] == [k % 2 for k in range(40)]
    assert [r.score for r in often] == pytest.approx([r.score for r in once], abs=1e-4)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.toxic for r in common.table(spark, sf, "labels").collect()}
    found = [(r.predicted, truth[r.doc_id]) for r in toxicity_fm.query(spark, sf).where("held_out").collect() if r.doc_id in truth]
    hit, called, toxic = sum(p and t for p, t in found), sum(p for p, _ in found), sum(t for _, t in found)
    print(len(found), hit, called, toxic)
    assert hit >= 0.7 * toxic and hit >= 0.7 * called


def test_stages_decide_by_row(spark):
    """Rows with null or repeated ids share no fate."""
    rng = random.Random(8)
    own = lambda: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(40))
    good = [own() for _ in range(6)]
    rows = [(None, t, "en", "a") for t in good[:3]] + [(7, t, "en", "b") for t in good[3:]]
    docs = frame(spark, [*rows, (None, good[0], "en", "a"), (None, "too short", "en", "a"), (7, "short too", "en", "b")])
    texts = lambda df: sorted(r.text for r in df.collect())
    assert texts(line_quality.kept_documents(docs)) == sorted([*good, good[0]])
    assert texts(simhash.one_row_of_each(docs)) == sorted([*good, "too short", "short too"])
    bad = zlib.crc32(b"vile") % toxicity_fm.BUCKETS
    model = toxicity_fm.blank(-5.0)
    model.w[bad] = 40
    both = frame(spark, [*rows, (None, "vile words", "en", "a"), (7, "so vile", "en", "b")])
    assert texts(toxicity_fm.not_toxic(both, model)) == sorted(good)
    assert source_mix.mixed_documents(frame(spark, [(None, f"{own()} {k}", "en", "a") for k in range(5)])).distinct().count() == 5


# -- pipeline -------------------------------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline

    docs = common.table(spark, SF, "documents")
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, SF)
        assert sorted(out.columns) == sorted(docs.columns)
        docs = common.materialize(out, "test")
        assert docs.count() > 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0


@pytest.fixture(scope="module")
def odd_corpus(spark, tmp_path_factory):
    """Clean texts of two sources, toxic ones, exact and near copies, short, null and empty ones, null and repeated ids,
    and columns with the names of the stages' own."""
    rng, base = random.Random(21), tmp_path_factory.mktemp("corpus")
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    text = lambda n=120: " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n))
    clean = [text() for _ in range(60)]
    toxic = [f"{text(60)} vileword {text(20)}" for _ in range(60)]
    rows = [(k, t, "xx", "a" if k % 3 else "b") for k, t in enumerate(clean)]
    rows += [(100 + k, t, "xx", "a") for k, t in enumerate(toxic)]
    rows += [(200 + k, clean[k], "xx", "b") for k in range(5)] + [(300 + k, clean[k] + " end", None, "a") for k in range(5)]
    rows += [(None, text(), "xx", "a"), (None, text(), "xx", None), (None, None, None, None), (7, text(), "xx", "b"), (401, "", "xx", "a"), (402, "too short", "xx", "a")]
    rows += [rows[0]] * 3
    columns = "doc_id long, text string, lang string, source string, size long, kept boolean, fp long, copies long, score double, row_no long, host string"
    spark.createDataFrame([(*r, 1, False, 2, 9, 0.5, 4, "h") for r in rows], columns).write.parquet(str(base / "documents.parquet"))
    spark.createDataFrame([(k, 0) for k in range(60)] + [(100 + k, 1) for k in range(60)], "doc_id long, toxic int").write.parquet(str(base / "labels.parquet"))
    return str(base), clean, toxic, rows


def test_pipeline_of_odd_rows(spark, odd_corpus):
    """Each stage does what it says, on what the one before left."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    base, clean, toxic, rows = odd_corpus
    docs = common.table(spark, base, "documents")
    kept = []
    for name, f in corpus_pipeline.STAGES[:-1]:
        docs = common.materialize(f(spark, docs, base), "test")
        assert docs.columns == common.table(spark, base, "documents").columns, name
        kept.append([(r.doc_id, r.text) for r in docs.collect()])
    after_toxic, after_rules, after_dedup, mixed = kept
    assert not [t for _, t in after_toxic if t and "vileword" in t] and len(after_toxic) == len(rows) - len(toxic)
    assert sorted(after_rules, key=str) == sorted(((i, t) for i, t in after_toxic if len((t or "").split()) >= 10), key=str)
    # one of each class of fingerprints within four bits; the texts that are unlike all others stay, whatever their ids
    fps = [slow_fingerprint(t) for _, t in after_rules]
    classes = union_find(fps, list(range(len(fps))))
    assert len(after_dedup) == len(set(classes.values())) and set(clean) <= {t for _, t in after_dedup} | {c + " end" for c in clean}
    assert len([1 for i, _ in after_dedup if i is None]) == 2 and len([1 for i, _ in after_dedup if i == 7]) == 2
    assert set(mixed) <= set(after_dedup) and max(mixed.count(x) for x in set(mixed)) <= 3
    found = corpus_pipeline.run(spark, base).collect()
    t = Tokenizer.from_file(VOCABULARY)
    assert sum(r.length for r in found) == sum(len(t.encode(x, add_special_tokens=False).ids) + 1 for _, x in mixed)


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    docs = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], docs).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_prefix_words_outlast_chunks(monkeypatch):
    """A word is worked out once, however often the dictionary of chunks is emptied; each dictionary keeps to its own bound."""
    counts = token_prefix.PrefixCounts(ChunkEncoder(token_prefix.vocabulary()))
    monkeypatch.setattr(token_prefix, "_KEEP", 3)
    worked, steps = [], counts.steps
    monkeypatch.setattr(counts, "steps", lambda w: worked.append(w) or steps(w))
    texts = ["Erste, zweite dritte. vierte!", "erste zweite; Dritte vierte", "Éérste naïve\x7f\x01 ab\x1fc it's 'tis é <|x|> 12.5 日本"] * 3
    for text in texts:
        table, alone = token_prefix.PrefixTable(text, counts), token_prefix.PrefixCounts(ChunkEncoder(token_prefix.vocabulary()))
        assert table.table() == token_prefix.PrefixTable(text, alone).table()
        assert table.total() == len(counts.tokenizer.encode(text, add_special_tokens=False).ids) and len(counts) <= 3
    assert len(worked) == len(set(worked)) and "erste" in worked
    monkeypatch.setattr(token_prefix, "_KEEP_WORDS", 2)
    assert token_prefix.PrefixTable(texts[0], counts).table() and not counts.words


def test_mixing_counts_units_in_one_exchange(spark):
    """Lists of next bytes are dealt by unit once and taken apart after that; kinds of counts are their logarithms."""
    import numpy as np

    docs = spark.createDataFrame([(k, "ab cd ab " * (k + 1) + f"x{k}") for k in range(6)], "doc_id long, text string")
    counted = context_mixing.counted_units(context_mixing.postings(docs.repartition(3)))
    assert counted._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(unit") == 1
    found = {bytes(r.unit): dict(zip(r.nexts, r.counts)) for r in counted.collect()}
    held = {k for k in range(6) if zlib.crc32(str(k).encode()) % 7 == 2}
    train = [k for k in range(6) if k not in held]
    n = sum(k + 1 for k in train)
    assert found[b"ab"] == {ord("c"): n, ord("a"): sum(train), ord("x"): len(train)} and found[b"cd"] == {ord("a"): n}
    sums = np.array([0, 1, 2, 3, 6, 7, 1000, 1 << 22], np.float32)
    assert context_mixing.states(sums, np.zeros_like(sums))[1].tolist() == [8 + min(int(x + 1).bit_length() - 1, 7) for x in sums]


def test_column_ids_look_words_up_once(monkeypatch):
    """Ids of a column are the library's, text by text; a word is encoded once, whatever its letters' case and the signs after it."""
    import pyarrow as pa

    from keyflow.llm import word_tokens

    encoder, rng = ChunkEncoder(VOCABULARY), random.Random(8)
    letters = "aabbcdeeQÀéßÿŸñ'<|>.,!?$_^`{~ 01²北\u0301\u0338İ\u3000\xa0\x00\x1c😀 \t\n "
    texts = [None, "", " \n ", "!!<|endoftext|>'re", *("".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(400)), "Été été! ÉTÉ... été?! don't' x= x<\u0338", None]
    monkeypatch.setattr(word_tokens, "_KEEP", 3)
    for at_once, column in ((1, pa.array(texts)), (100, pa.array(["x", *texts], pa.large_string()).slice(1)), (8 << 20, pa.array(texts))):
        monkeypatch.setattr(word_tokens, "_AT_ONCE", at_once)
        found = [[int.from_bytes(i[k : k + 4], "little") for k in range(0, len(i), 4)] for i in encoder.column_ids(column)]
        assert found == [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    fresh, worked = ChunkEncoder(VOCABULARY), []
    whole = fresh._stem
    monkeypatch.setattr(fresh, "_stem", lambda w: worked.append(w) or whole(w))
    words = [f"word{a}{b}" for a in "abcdé" for b in "xyz"]
    list(fresh.column_ids(pa.array([" ".join(w.upper() + s if k % 2 else w + s for w in words for s in ("", ".", "$$")) for k in range(8)])))
    assert sorted(worked) == sorted(words) and list(fresh.column_ids(pa.array([], pa.string()))) == []


def test_mixing_parts_and_postings_from_columns(spark):
    """A part takes its Arrow columns as they are, in any order; postings agree with plain counts over more texts than are taken apart at a time."""
    import numpy as np
    import pyarrow as pa

    cm = context_mixing
    counts = {cm.START: {97: 2}, b"a": {255: 1, 98: 4}, b"abc": {0xC3: 3}, "é".encode(): {97: 0}, cm.END: {0: 9}}
    rows = [(0, u, False, list(c), list(c.values())) for u, c in reversed(counts.items())] + [(0, b"abcde", True, [102], [5])]
    table = pa.Table.from_pylist([dict(zip(("part", "unit", "ghost", "nexts", "counts"), r)) for r in rows], pa.schema([("part", pa.int32()), ("unit", pa.binary()), ("ghost", pa.bool_()), ("nexts", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))]))
    for some in (table, pa.concat_tables([table.slice(0, 2), table.slice(2)])):
        (part,) = cm.parts(some)
        assert part.units.to_pylist() == sorted(counts) and part.ns.tolist() == [sum(counts[u].values()) for u in sorted(counts)]
        assert part.words.tolist() == [1, 2, 3] and part.rest.data.tobytes() == b"a abc " + "é ".encode() and part.ghosts == [(b"abcde", 102, 5)]
        assert part.followed.tolist() == [0, 1, 1, 2, 3] and part.after.tolist() == [97, 255, 98, 0xC3, 97] and part.head.ns.tolist() == [2, 1, 4, 3, 0]
        last = np.array([0, 97, 97, int.from_bytes(b"bc", "little"), int.from_bytes("é".encode(), "little")], np.uint64)
        assert part.head.hashes[1].tolist() == cm.hashed(last, len(cm.REST) + 1).tolist()
    (empty,) = cm.parts(table.slice(0, 0))
    assert not len(empty.count().words) and not len(next(cm.parts(table.filter(pa.compute.equal(table["unit"], cm.START)))).count().words)

    texts = [None, "", " \t\n", *(f"  A{k % 7}\tb{k % 3}\x0b É{k} \n" if k % 2 else f"a{k % 7} x\x1cy" for k in range(5000)), " a  a a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    found, follow = cm.postings(docs).collect(), {}
    split = [(t or "").encode().lower().split() for t in texts]
    assert [(r.row, r.doc_id, r.n_tokens, r.n_bytes) for r in found if r.unit is None] == [(k, k, len(w) + 1, len(b" ".join(w)) + 1 + bool(w)) for k, w in enumerate(split)]
    for k, w in enumerate(split):
        for a, b in zip([cm.START, *w, cm.END], [*w, cm.END, b"\0"]):
            follow.setdefault(a, {}).setdefault(b[0], 0)
            follow[a][b[0]] += zlib.crc32(str(k).encode()) % 7 != 2
    assert sorted(bytes(r.unit) for r in found if r.unit is not None) == sorted(follow)
    assert {bytes(r.unit): {f >> cm._FOLLOW: f & (1 << cm._FOLLOW) - 1 for f in r.follow} for r in found if r.unit is not None} == follow
