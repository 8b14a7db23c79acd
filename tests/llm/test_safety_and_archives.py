import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import pytest
from helpers import EDGES, LONG, docs, rows

from strandline.llm import licenses, toxicity, warc


# --- WARC --------------------------------------------------------------------------------------------------------


def pages(spark, data):
    return spark.createDataFrame(data, "page_id long, url string, html string")


BIG = "<p>é</p>" * 200


def test_archives_round_trip(spark, tmp_path):
    data = [(1, "http://a/ b\n", BIG), (2, None, BIG), (9, "http://c", BIG), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (7, "u", BIG + "x"), (None, "u", BIG), (-8, "u", "WARC/1.1\r\n\r\nx\r\n\r\n" * 90), (10, "u", BIG + "\n"), (10, "u", BIG + "\n")]
    got = rows(warc.archive_pages(pages(spark, data), str(tmp_path / "w")))
    assert len(got) == len(data)
    for r in got:
        texts = {t or "" for i, _, t in data if i == r["page_id"]}
        (t,) = texts
        raw = t.encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
        revisit = r["page_id"] in (1, 2)
        assert (r["record_type"], r["refers_to"]) == (("revisit", 9) if revisit else ("response", None))
        assert r["payload"] is None if revisit else bytes(r["payload"]) == raw
    assert {r["uri"] for r in got if r["page_id"] in (1, 2)} == {"http://a/%20b%0A", "about:blank"}
    files = [f for f in Path(tmp_path / "w").glob("part-*")]
    whole = [gzip.decompress(f.read_bytes()) for f in files]  # as any reader sees them
    heads = [h for w in whole for h, _ in warc.parse_warc(w)]
    assert whole == [b"".join(warc.members(f.read_bytes())) for f in files]
    assert all(m.count(b"WARC-Record-ID") == 1 for f in files for m in warc.members(f.read_bytes()))
    assert {h["warc-type"] for h in heads} == {"warcinfo", "response", "revisit"}
    assert len({h["warc-record-id"] for h in heads if h["warc-type"] != "warcinfo"}) == len(data) - 1  # one row is repeated


def test_files_are_bounded_by_bytes_and_columns_may_clash(spark, tmp_path):
    """Payloads of megabytes that hardly compress, one over 16 MB, whose gzip trailer ends otherwise."""
    rng = random.Random(5)
    data = [(i, "u", "".join(map(chr, rng.choices(range(33, 500), k=300_000)))) for i in range(6)] + [(9, "u", "x" * (17 << 20)), (10, "v", "x" * (17 << 20))]
    df = pages(spark, data).repartition(1).selectExpr("*", "7 as payload", "8 as first", "9 as record_id", "10 as _size", "11 as refers_to")
    folder = str(tmp_path / "w")
    warc.write_warc(warc.mark_revisits(warc.arc_to_warc(warc.pages_to_arc(df))), folder, file_bytes=500_000)
    sizes = [f.stat().st_size for f in Path(folder).glob("part-*")]
    assert len(sizes) >= 3 and max(sizes) < 1_200_000
    got = {r["page_id"]: r for r in rows(warc.read_warc(spark, folder))}
    assert all(got[i]["payload_digest"] == hashlib.sha1(t.encode()).hexdigest() for i, _, t in data)
    assert got[9]["refers_to"] == 10 and got[10]["record_type"] == "response" and bytes(got[3]["payload"]).decode() == data[3][2]


def test_empty_table(spark, tmp_path):
    assert warc.archive_pages(pages(spark, []), str(tmp_path / "w")).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    body = warc._http(5, b"x\ny") + b"x\ny"
    data = warc.arc_head(version, "n.arc") + warc.arc_record(version, "http://a/", body, 0, "n.arc") * 2
    got = list(warc.parse_arc(data))
    assert [b for _, b in got] == [body, body] and got[0][0]["URL"] == "http://a/"
    assert ("Checksum" in got[0][0]) == (version == 2)
    with pytest.raises(ValueError, match="shorter"):
        list(warc.parse_arc(data[:-4]))
    with pytest.raises(ValueError):
        list(warc.parse_arc(data.replace(b"%d 0 strandline" % version, b"3 0 strandline")))


@pytest.mark.parametrize("version", [1, 2])
def test_types_of_converted_records(spark, tmp_path, version):
    """The version block, HTTP and DNS answers and other records each become what WARC has for them."""
    page = warc._http(5, b"<p>") + b"<p>"
    dns, ftp = b"20240101000000\nexample.org. 300 IN A 192.0.2.1\n", b"a file \r\n\r\n of blanks"
    data = warc.arc_head(version, "n.arc") + b"".join(warc.arc_record(version, u, b, 0, "n.arc") for u, b in (("http://a/", page), ("dns:example.org", dns), ("ftp://a/f", ftp)))
    records = warc.arc_to_warc(spark.createDataFrame([(data,), (None,)], "archive binary"))
    got = {r["uri"]: r for r in rows(records)}
    told = {u: (r["record_type"], r["content_type"], r["page_id"], r["date"]) for u, r in got.items()}
    assert told == {
        "filedesc://n.arc": ("warcinfo", "application/warc-fields", None, "2024-01-01T00:00:00Z"), "http://a/": ("response", "application/http; msgtype=response", 5, "2024-01-01T00:00:00Z"),
        "dns:example.org": ("response", "text/dns", None, "2024-01-01T00:00:00Z"), "ftp://a/f": ("resource", "text/html", None, "2024-01-01T00:00:00Z"),
    }
    assert bytes(got["dns:example.org"]["payload"]) == dns and bytes(got["ftp://a/f"]["payload"]) == ftp and bytes(got["http://a/"]["payload"]) == b"<p>"
    assert f"ARC, {version} 0" in bytes(got["filedesc://n.arc"]["payload"]).decode()
    warc.write_warc(warc.mark_revisits(warc.settle(records)), str(tmp_path / "w"))
    back = {r["uri"]: (r["record_type"], r["payload_bytes"], bytes(r["payload"])) for r in rows(warc.read_warc(spark, str(tmp_path / "w")))}
    assert back == {"http://a/": ("response", 3, b"<p>"), "dns:example.org": ("response", len(dns), dns), "ftp://a/f": ("resource", len(ftp), ftp)}
    heads = [h for f in (tmp_path / "w").glob("part-*") for m in warc.members(f.read_bytes()) for h, _ in warc.parse_warc(m)]
    assert [h["warc-filename"] for h in heads if "warc-filename" in h] == ["n.arc"]


def test_checksums_of_archives_are_verified():
    body = b"some bytes"
    data = warc.arc_head(2, "n.arc") + warc.arc_record(2, "http://a/", body, 0, "n.arc")
    assert len(list(warc.parse_arc(data))) == 1 and len(list(warc.parse_arc(data, described=True))) == 2
    with pytest.raises(ValueError, match="checksum"):
        list(warc.parse_arc(data.replace(body, b"other byte")))


def test_bad_archives_are_refused():
    good = warc.warc_record([("WARC-Type", "response")], b"abc")
    assert len(list(warc.parse_warc(good * 2))) == 2
    for bad in (good[:-2], b"x" + good, good + b"\r\n"):
        with pytest.raises(ValueError):
            list(warc.parse_warc(bad))


def test_record_ids_hold_page_ids():
    for n in (0, 1, 15, 16, 65535, 65536, 2**63 - 1, -1, -(2**63)):
        assert warc.page_of(warc.record_uuid(n, b"")) == n
    assert warc.page_of(warc.record_uuid(None, b"x")) is None


# --- toxicity ------------------------------------------------------------------------------------------------------


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_against_edit_distances():
    rng = random.Random(1)
    terms = ["idiot", "clown", "trash", "scum", "pathetic", "lostra*", "veq*"]
    a = toxicity.Automaton(terms)
    plain = [t for t in terms if not t.endswith("*")]
    for _ in range(4000):
        base = rng.choice([t.rstrip("*") for t in terms])
        w = list(base)
        for _ in range(rng.randint(0, 2)):
            p = rng.randint(0, len(w))
            rng.choice([lambda: w.insert(p, rng.choice("abst")), lambda: w.pop(p) if p < len(w) else None, lambda: w.__setitem__(p, "x") if p < len(w) else None])()
        word = "".join(w)
        if not word:
            continue
        exact = {t for t in plain if t == word} | {t for t in terms if t.endswith("*") and word.startswith(t[:-1])}
        # one edit after the first letter; of stems any beginning of the word may be the misspelled stem
        fuzzy = {t for t in plain if len(t) >= 5 and brute_distance(word, t) == 1 and word[0] == t[0]}
        fuzzy |= {t for t in terms if t.endswith("*") and len(t) > 6 and word[0] == t[0] and any(brute_distance(word[:n], t[:-1]) <= 1 for n in range(1, len(word) + 1))}
        got = a.look(word)
        if exact:
            assert got and got[0] in exact and got[1] == 0, word
        elif got:
            assert got[1] == 1 and got[0] in fuzzy, (word, got)
        else:
            # an inserted copy of the first letter can be read as an edit before it
            assert not fuzzy or word[0] == word[1:2], (word, fuzzy)


def labelled(spark, n=600):
    rng = random.Random(2)
    bad = ["idiot", "clown", "moron", "lostraum", "lostraei", "lostrack"]
    data, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(20, 80))]
        if i % 5 == 0:
            for _ in range(3):
                words.insert(rng.randint(0, len(words)), rng.choice(bad))
        data.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 5 == 0)))
    return data, spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_edges(spark):
    data, labels = labelled(spark)
    df = docs(spark, [*data, *EDGES[2:]])
    model = toxicity.fit(df, labels)
    got = rows(toxicity.scores(df, model))
    assert len(got) == len(data) + len(EDGES) - 2
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] > 9 and toxicity.is_held_out(r["doc_id"])]
    assert len(held) > 100 and all(r["predicted"] == (r["doc_id"] % 5 == 0) for r in held)
    assert all(0 <= r["score"] <= 1 for r in got) and all(r["predicted"] == (r["score"] >= 0.7) for r in got)
    kept = toxicity.drop_toxic(df, model)
    assert kept.columns == df.columns and kept.count() == sum(not r["predicted"] for r in got)
    assert model.score("such an idoit and a moronn, a clwn and an idiott") > model.score("such a day")
    loud, quoted = "you idiot you clown", 'he wrote: "idiot" and then "clown", the word'
    assert model.evidence(quoted) < model.evidence(loud)
    assert model.evidence(None) == model.evidence("") == 0 and model.score(LONG) <= model.score("") < 0.5
    # labels of the held-out rows are never looked at
    flipped = labels.selectExpr("doc_id", "quality", f"case when crc32(cast(cast(doc_id as string) as binary)) % {toxicity.FOLDS} = {toxicity.HELD_OUT} then 1 - toxic else toxic end as toxic")
    again = toxicity.fit(df, flipped)
    assert (again.weights, again.repeated, again.bias, again.slope, again.per_length) == (model.weights, model.repeated, model.bias, model.slope, model.per_length)
    nothing = toxicity.fit(df, labels.where("false"))
    assert all(r["predicted"] == 0 for r in rows(toxicity.scores(df, nothing)))
    assert toxicity.scores(df.where("false"), model).count() == 0


def test_automaton_with_edits_everywhere():
    """Every word within one edit of a term, first letters, short terms and symbols included, and no other."""
    rng = random.Random(7)
    terms = ["idiot", "clown", "scum", "ass", "lostra*", "veq*", "iron"]
    a = toxicity.Automaton(terms, [(t, k) for t in terms for k in toxicity.KINDS])
    n_hits = 0
    for _ in range(4000):
        w = list(rng.choice([t.rstrip("*") for t in terms]) + rng.choice(["", "", "x", "ion"]))
        for _ in range(rng.randint(0, 2)):
            p = rng.choice([0, rng.randint(0, len(w) - 1)])
            rng.choice([lambda: w.insert(p, rng.choice("abis$")), lambda: w.pop(p), lambda: w.__setitem__(p, rng.choice("xi!"))])()
        word = "".join(w)
        if not toxicity.SPELLED.fullmatch(word):
            continue
        forms = {word, word.lstrip(toxicity.SYMBOLS)}
        least = {t: min(brute_distance(f[:n], t.rstrip("*")) for f in forms for n in (range(len(f) + 1) if t.endswith("*") else [len(f)])) for t in terms}
        want = min(least.values())
        got = a.look(word)
        assert (got is not None) == (want <= 1), (word, got)
        if got:
            n_hits += 1
            assert got[1] == want == least[got[0]], (word, got)
            assert {t for t, _ in a.near(word)} == ({t for t in terms if least[t] == 1} if want else set()), word
    assert n_hits > 2000
    # each kind by itself
    for kind, yes, no in ((toxicity.INNER, "idot", "diot"), (toxicity.FIRST, "diot", "idot"), (toxicity.SYMBOL, "!diot", "diot")):
        a = toxicity.Automaton(["idiot"], [("idiot", kind)])
        assert a.look(yes) == ("idiot", 1) and a.look(no) is None and a.look("idiot") == a.look("*idiot") == ("idiot", 0)


def test_misspelled_first_letters_and_short_terms_are_evidence(spark):
    rng = random.Random(8)
    data = []
    for i in range(600):
        words = ["".join(rng.choice("etaoinhr") for _ in range(rng.randint(5, 8))) for _ in range(rng.randint(20, 60))] + ["rash"] * (i % 3 == 0)
        data.append((i, " ".join([*words, *(["idiot", "stupid", "scum", "trash"] if i % 5 == 0 else [])])))
    model = toxicity.fit(docs(spark, data), spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i, _ in data], "doc_id long, quality int, toxic int"))
    for w in ("$tupid", "!diot", "tupid", "xdiot", "$cum", "scvm", "*dumb* $tupid", "trssh", "$rash"):
        assert model.evidence(f"you {w} there") > 0, w
    assert model.evidence("*idiot*") == model.evidence("idiot") > model.evidence("!diot")
    # an ordinary word in clean rows is no misspelling, and takes no other kind of edit away
    assert model.evidence("a rash there") == 0


def test_beginnings_count_where_they_are_repeated(spark):
    """Single words of a beginning stand in clean rows too; three of them only in toxic ones."""
    rng = random.Random(11)
    syllables = ["ka", "lo", "mi", "tu", "re", "na", "so", "vi"]
    word = lambda head="": head + "".join(rng.choices(syllables, k=rng.randint(2, 4)))
    data = []
    for i in range(900):
        words = [word() for _ in range(rng.randint(40, 90))]
        words += [word("zorbax") for _ in range(rng.randint(3, 5) if i % 6 == 0 else int(rng.random() < 0.15))]
        rng.shuffle(words)
        data.append((i, " ".join(words)))
    model = toxicity.fit(docs(spark, data), spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i, _ in data], "doc_id long, quality int, toxic int"))
    assert "zorbax*" in model.repeated
    held = [(i % 6 == 0, model.score(t) >= toxicity.THRESHOLD) for i, t in data if toxicity.is_held_out(i)]
    assert sum(p for y, p in held if y) >= 0.9 * sum(y for y, _ in held) and sum(p for y, p in held if not y) <= 3


def brute_score(model, text):
    """The whole score by its plain definition: every word against every term by edit distance, every hit's context."""
    low = (text or "").lower()
    total, times = 0.0, Counter()
    for m in toxicity.SPELLED.finditer(low):
        forms = [m[0], m[0].lstrip(toxicity.SYMBOLS)]
        exact = [t for t in model.weights if any(f == t or t.endswith("*") and f.startswith(t[:-1]) for f in forms)]
        value = model.weights[min(exact, key=lambda t: t)] if exact else 0.0
        if not exact:
            near = toxicity.Automaton(model.weights, [(t, k) for t in model.weights for k in toxicity.KINDS]).near(m[0])
            near = {(t, k) for t, k in near if (t, k) in model.fuzzy}
            assert all(min(brute_distance(f[:n], t.rstrip("*")) for f in forms for n in (range(len(f) + 1) if t.endswith("*") else [len(f)])) == 1 for t, _ in near)
            value = toxicity.MISSPELLED * max((model.weights[t] for t, _ in near), default=0.0)
        stems = [s for s in model.repeated if any(f.startswith(s[:-1]) for f in forms)]
        held = 1.0
        before, after = low[max(0, m.start() - toxicity.WINDOW) : m.start()], low[m.end() : m.end() + toxicity.WINDOW]
        if set(re.findall(r"\w+(?:[*@$!]\w+)*", before)[-3:] + re.findall(r"\w+(?:[*@$!]\w+)*", after)[:3]) & toxicity.REPORTING or before.count('"') % 2 and '"' in after:
            held = toxicity.QUOTED
        total += value * held
        for s in stems[:1]:
            times[s] += held
    total += sum(model.repeated[s][1] * n / model.repeated[s][0] for s, n in times.items() if n >= model.repeated[s][0])
    z = model.bias + model.slope * math.log1p(total) + model.per_length * math.log1p(len(toxicity.SPELLED.findall(low)))
    chance = 0.7 / (0.7 + 0.3 * math.exp(-z))
    return chance if total >= min(model.weights.values()) else min(chance, 0.69)


def test_score_against_brute_force():
    rng = random.Random(12)
    model = toxicity.Model({"idiot": 3.0, "scum": 2.5, "lostra*": 4.0}, frozenset({("idiot", toxicity.INNER), ("idiot", toxicity.SYMBOL), ("lostra*", toxicity.INNER)}), {"zorb*": (2, 3.5)}, -3.0, 2.0, -0.3)
    pool = ["idiot", "idiott", "!diot", "diot", "scum", "scom", "lostraum", "lostum", "losxraum", "zorbax", "zorba", "the", "said", "plain", '"', "wörter", "idi", "$cum"]
    for _ in range(300):
        text = " ".join(rng.choices(pool, k=rng.randint(0, 30)))
        assert model.score(text) == pytest.approx(brute_score(model, text)), text


def test_fold_is_the_crc():
    assert [toxicity.is_held_out(i) for i in range(20)] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in range(20)]


# --- licenses ------------------------------------------------------------------------------------------------------


def brute_licenses(data, contained=licenses.CONTAINED):
    def shingles(t):
        t = (t or "").lower()
        for c in licenses.BREAKS:
            t = t.replace(c, " ")
        w = [x for x in re.split(" ", t.replace(licenses.DROPPED, "")) if x]
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]

    out = {}
    for i, t in data:
        s = shingles(t)
        for name, words in licenses.TEMPLATES.items():
            want = set(shingles(words))
            # windows as the operator cuts them
            n = len(want)
            best = max((len(want & set(s[a : a + 3 * n])) / n for a in range(0, max(1, len(s)), n)), default=0)
            if best >= contained:
                out[i, name] = best
    return out


def test_licenses_against_brute_force(spark):
    rng = random.Random(3)
    data = [r[:2] for r in EDGES if r[0] is not None]
    for i in range(100, 160):
        words = [f"w{rng.randint(0, 999)}" for _ in range(rng.randint(0, 300))]
        name = rng.choice(list(licenses.TEMPLATES))
        notice = licenses.TEMPLATES[name].upper().split() if i % 2 else licenses.TEMPLATES[name].split()
        if i % 5 == 0 and len(notice) > 20:
            notice[rng.randrange(len(notice))] = "changed"
        at = rng.randint(0, len(words))
        data.append((i, " ".join(words[:at] + notice + words[at:])))
    df = docs(spark, data)
    got = {(r["doc_id"], r["license"]): r["containment"] for r in rows(licenses.scan(df))}
    assert got == pytest.approx(brute_licenses(data)) and len(got) > 50
    assert licenses.scan(df.where("false")).count() == 0
    with pytest.raises(ValueError, match="fewer"):
        licenses.scan(df, {"x": "too short"})


def test_licenses_in_rows_without_an_id_and_at_any_place(spark):
    """Rows without an id are found as one; a whole template is found wherever it stands, a folder's templates too."""
    whole = licenses.TEMPLATES["ISC-text"]
    data = [(None, whole), (None, "x " + licenses.TEMPLATES["MIT-text"]), (5, None), (6, ""), *((100 + k, "word " * k + whole + " more" * (300 - k)) for k in range(0, 300, 13))]
    got = {(r["doc_id"], r["license"]): r["containment"] for r in rows(licenses.scan(docs(spark, data)))}
    assert got[None, "ISC-text"] == got[None, "MIT-text"] == 1
    assert all(got[100 + k, "ISC-text"] == 1 for k in range(0, 300, 13)) and not any(i in (5, 6) for i, _ in got)


def test_templates_from_a_folder(spark, tmp_path):
    (tmp_path / "one.txt").write_text("alpha beta gamma delta epsilon zeta")
    templates = licenses.read_templates(spark, str(tmp_path))
    assert [tuple(r) for r in templates.select("license", "words").collect()] == [("one", "alpha beta gamma delta epsilon zeta")]
    found = rows(licenses.scan(docs(spark, [(1, "so Alpha, beta gamma\ndelta epsilon zeta."), (2, "alpha beta")]), templates))
    assert [(r["doc_id"], r["license"]) for r in found] == [(1, "one")]


def test_hundreds_of_long_templates(spark):
    """Templates are a table: 300 of 400 words are found as one is, in rows that repeat ids too."""
    rng = random.Random(8)
    texts = {f"t{k}": " ".join(f"w{rng.randint(0, 400)}" for _ in range(400)) for k in range(300)}
    data = [(k, f"before {texts[f't{k * 7}']} after") for k in range(40)] + [(1, "before " + texts["t299"][: len(texts["t299"]) // 2]), (1, texts["t299"][len(texts["t299"]) // 2 :]), (2, None)]
    got = {(r["doc_id"], r["license"]) for r in rows(licenses.scan(docs(spark, data), texts))}
    assert got == {(k, f"t{k * 7}") for k in range(40)}  # two halves in two rows of an id aren't a whole
    assert licenses.scan(docs(spark, data), spark.createDataFrame([], "license string, words string")).count() == 0


def test_labelled_ids_that_repeat_are_learned_once(spark):
    """A labelled id that many rows repeat brings one of them, the same whatever the partitions."""
    own = [(k, f"row {k} of plain words and {'awful idiot' if k % 2 else 'nice people'} number{k * k}") for k in range(120)] + [(3, f"other text {k}") for k in range(300)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(120)], "doc_id long, toxic int")
    frame = docs(spark, own)
    sample, _ = toxicity._sample(frame, labels, 1000, "doc_id", "text")
    ids = [r["id"] for r in sample.collect()]
    assert len(ids) == len(set(ids)) and 3 in ids or toxicity.HELD_OUT == zlib.crc32(b"3") % 3
    one, other = (toxicity.fit(frame.repartition(n), labels) for n in (3, 8))
    assert one.weights == other.weights and one.bias == other.bias
