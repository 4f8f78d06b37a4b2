"""Operators on small tables with nulls, empty and long texts, ties, repeated rows and extra columns, against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

pytestmark = pytest.mark.filterwarnings("ignore")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, th int, found string, place string, word string, sid string"


def low(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x)


def corpus():
    rng = np.random.default_rng(3)
    words = ["ab", "cde", "Élan", "fox", "the", "of", "stone", "river", "under", "Moon", "x1", "ß", "quiet", "lamp"]
    text = lambda n: " ".join(rng.choice(words, n))
    shared, base = text(60), text(120)
    texts = [None, "", "   \n", "one", text(3), shared, text(20) + " " + shared + " " + text(30), shared + "\n" + text(5), base, base, base + " tail", "Head " + base.lower(), text(400), "a" * 700, "b" + "a" * 700]
    near = base.split()
    for i in range(6):
        near = near.copy()
        near[7 * i] = f"edit{i}"
        texts.append(" ".join(near))
    texts += [base.upper(), "tab\tand\x0bfeed " + shared[:150], shared + shared, text(30) + " " + base[50:400] + " " + text(9)]
    return [(i, t) for i, t in enumerate(texts)]


def docs(spark, rows=None):
    rows = corpus() if rows is None else rows
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), 1, "f", "p", "w", "s") for d, t in rows], SCHEMA)


def test_suffix_dedup_against_brute_force(spark):
    from sunledger.llm import suffix_dedup as S

    rows = [*corpus(), (5, corpus()[5][1]), (8, "again")]
    texts = [(d, (t or "").encode()) for d, t in rows]
    count = Counter(b[i : i + 200] for _, b in texts for i in range(len(b) - 199))
    want = []
    for d, b in texts:
        gone = [False] * len(b)
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                gone[i : i + 200] = [True] * 200
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        want.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    for most in (S.MAX_PARTNERS, 2, 1):  # anchors as they are, and lengthened
        got = S.suffix_dedup(docs(spark, rows), max_partners=most).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_suffix_rows_give_true_prefixes():
    from sunledger.llm.suffix_dedup import long_prefix_rows, suffix_rows

    rng = np.random.default_rng(1)
    text = np.concatenate([rng.integers(97, 100, 300), rng.integers(97, 99, 40)]).astype(np.uint8)
    text = np.concatenate([text, [255], text[50:200], [255]]).astype(np.uint8)
    order = suffix_rows(text, 32)
    turned = [bytes(np.roll(text, -i))[:32] for i in order]
    assert turned == sorted(turned)
    common = [0] + [next((k for k in range(32) if a[k] != b[k]), 32) for a, b in zip(turned, turned[1:], strict=False)]
    for length in (1, 5, 20):
        assert long_prefix_rows(text, order, length)[1:].tolist() == [c >= length for c in common[1:]]


def test_anchors_do_not_depend_on_the_chunk(monkeypatch):
    from sunledger.llm import repeats as R

    rng = np.random.default_rng(3)
    values = rng.integers(0, 4, 500).astype(np.uint64)
    for width in (1, 2, 5, 137):
        assert R.first_least(values, width).tolist() == [i + int(values[i : i + width].argmin()) for i in range(500 - width + 1)]
    data = np.frombuffer((b"aaaaaaaab" * 40 + bytes(rng.integers(97, 100, 600).astype(np.uint8))), np.uint8)
    bounds = np.array([0, 300, len(data)])
    seq = R.Sequences("byte")
    want = [x.tolist() for x in seq.contexts(seq.load(data, bounds), 50, 8)]
    monkeypatch.setattr(R, "LOW", 10)
    seq = R.Sequences("byte")
    assert [x.tolist() for x in seq.contexts(seq.load(data, bounds), 50, 8)] == want


def test_substring_dedup_against_brute_force(spark):
    from sunledger.llm.substring_dedup import substring_dedup

    rows = [*corpus(), (5, corpus()[5][1])]
    words = [(d, WORD.findall(t or "")) for d, t in rows]
    least = {}
    for d, w in words:
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            least[k] = min(least.get(k, d), d)
    want = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if least[tuple(w[i : i + 13])] < d:
                gone[i : i + 13] = [True] * 13
        want.append((d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    got = substring_dedup(docs(spark, rows)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def components_of(rows, k, percent):
    sets = []
    for d, t in rows:
        w = WORD.findall(low(t or ""))
        sets.append((d, frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)]) for i, (d, s) in enumerate(sets))


def test_jaccard_components_against_brute_force(spark, monkeypatch):
    from sunledger.llm import jaccard_join as J

    rows = [*corpus(), (5, corpus()[5][1])]
    for k, percent, block in ((4, 85, 1024), (5, 80, 3)):
        monkeypatch.setattr(J, "BLOCK", block)
        monkeypatch.setattr(J, "SET_BLOCK", block)
        got = J.jaccard_components(docs(spark, rows), k, percent).select("doc_id", "n_shingles", "component_id").collect()
        assert sorted(map(tuple, got)) == components_of(rows, k, percent)


def test_links_find_every_component_whatever_the_prefixes():
    from sunledger.llm.jaccard_join import links

    rng = np.random.default_rng(5)
    base = [np.unique(rng.integers(0, 2**60, 60).astype(np.uint64)) for _ in range(4)]
    sets = []
    for _ in range(80):
        s = base[rng.integers(4)].copy()
        s[rng.integers(0, len(s), rng.integers(0, 8))] = rng.integers(0, 2**60)
        sets.append(np.unique(s))
    root = list(range(80))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(80):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    want = {frozenset(x for x in range(80) if find(x) == r) for r in {find(x) for x in range(80)}}
    root = list(range(80))
    for a, b in links(sets, 85):
        root[find(a)] = find(b)
    assert {frozenset(x for x in range(80) if find(x) == r) for r in {find(x) for x in range(80)}} == want


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from sunledger.llm import packing as P

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [*corpus(), (77, "isn't <|endoftext|> I'LL “x”.a;b " * 40), (5, corpus()[5][1])]
    plain = Tokenizer.from_file(path)
    want = Counter()
    for d, t in rows:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for piece, start in enumerate(range(0, len(ids), 256)):
            want[(d, piece, start, len(ids[start : start + 256]), zlib.crc32(ids[start : start + 256].tobytes()))] += 1
    got = P.pack_documents(docs(spark, rows), path, 256).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by) >= P.lower_bound(np.array([r["length"] for r in got]), 256)


def test_bounds_and_exchange(spark):
    from sunledger.llm import packing as P

    assert P.lower_bound(np.array([60, 60, 60, 41, 41]), 100) == 4  # the sum alone says 3
    rng = np.random.default_rng(2)
    rows = [(i, 0, 0, int(n), i) for i, n in enumerate(rng.integers(1, 4097, 3000))]
    pieces = spark.createDataFrame(rows, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    apart = P.pack(pieces, partition_pieces=100, exchange=False)
    joined = P.pack(pieces, partition_pieces=100)
    (alone, bound), (n, same) = P.certificate(apart), P.certificate(joined)
    assert joined.count() == 3000 and bound == same == P.lower_bound(np.array([r[3] for r in rows])) and bound <= n < alone
    assert joined.groupBy("sequence_id").agg(F.sum("length").alias("s"), F.max(F.col("offset") + F.col("length")).alias("e")).filter("s > 4096 or s <> e").count() == 0


def test_url_filter(spark):
    from sunledger.llm.registry import URL_RULES
    from sunledger.llm.url_filter import judge, split_words

    urls = [None, "nothing", "http://A.Example.COM/en/1?x#y", "http://example.com/en/7", "https://www.example.net/de/8", "x://net/de/", "http://example.org/fr/1", "http://barcom/en/", "http://", "a://b://c", "http://stonelamp.example.org/es/3?q"]
    titles = "<html><title>stone lamp stone lamp river the lamp stone</title>"
    pages = spark.createDataFrame([(i, u, titles if i % 3 else None, "x") for i, u in enumerate(urls)], "page_id bigint, url string, html string, host string")
    got = {r["page_id"]: r for r in judge(pages, URL_RULES).collect()}
    assert [(got[i]["host"], got[i]["path"]) for i in (0, 1, 2, 8, 9)] == [("", ""), ("", ""), ("a.example.com", "/en/1"), ("", ""), ("b:", "//c")]
    assert [got[i]["rule"] for i in range(11)] == [None, None, "com/en/", "example.com/en/7", "example.net/de/8", "net/de/", None, None, None, None, "org/es/"]
    assert [got[i]["verdict"] for i in (0, 1, 2, 3, 4, 5)] == ["allow", "allow", "block", "allow", "block", "allow"]
    model = {"": 100.0, "stone": -1.0, "lamp": -1.0, "the": -0.5}
    assert split_words("thestonelamp", model, [3, 4, 5]) == ["the", "stone", "lamp"] and split_words("", model, [3]) == []
    assert split_words("thexyzqw", model, [3, 4, 5]) == ["the", "xyzqw"]


def test_url_verdicts_against_brute_force(spark):
    from sunledger.llm.registry import URL_RULES
    from sunledger.llm.url_filter import judge, rule_of  # noqa: F401

    rng = np.random.default_rng(9)
    vocabulary = ["stone", "lamp", "river", "the", "moon", "fox", "one", "ton", "lampriver"]
    word = lambda: str(rng.choice(vocabulary))
    rows = []
    for i in range(80):
        bad = i % 2
        host = ("moon" if bad else "fox") + word() + word() + ("q" * int(rng.integers(0, 3))) + "." + ("com" if i % 4 < 2 else "example.net" if bad else "net")
        rows.append((i if i % 9 else None, f"http://{host}/" + ("en/" if i % 4 < 2 else "de/8" if bad and i % 3 else "de/") + f"{word()}{i % 12}?x=1", f"<title>{' '.join(word() for _ in range(4))}</title>"))
        rows.append((1000 + i, f"https://{'moon' if bad else 'fox'}{word()}.info/{word()}", None))
    count = Counter(w for _, _, h in rows if h for w in re.findall(r"[a-z]{2,}", re.search("<title>(.*)</title>", h)[1]))
    total = sum(count.values())

    def splits(run):
        if not run:
            return [[]]
        return [[run[:n], *rest] for n in range(1, len(run) + 1) for rest in splits(run[n:])]

    def cost(words):
        return sum(math.log10(count[w] / total) if count[w] else 1 - math.log10(total) - len(w) for w in words)

    def tokens(url):
        host, path = re.match(r"[^:]*://([^/]*)(/[^?]*)", url).groups()
        labels = host.split(".")
        out = []
        for kind, text in (("h:", " ".join(labels[:-1])), ("p:", path)):
            for run in re.findall("[0-9]+|[a-z]+", text):
                out += [f"{kind}#{len(run)}"] if run[0].isdigit() else [kind + w for w in max(splits(run), key=cost)]
        return host, path, [*out, "e:" + labels[-1]]

    def decided(host, path):
        fits = [(len(r), act) for act, r in URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        return max(fits)[1] if fits else None

    seen = [(i, *tokens(u)) for i, u, _ in rows]
    acts = [decided(h, p) for _, h, p, _ in seen]
    bag = {a: Counter(t for (_, _, _, ts), x in zip(seen, acts, strict=True) if x == a for t in ts) for a in ("block", "allow")}
    size, sums = len(set(bag["block"]) | set(bag["allow"])), {a: sum(c.values()) for a, c in bag.items()}
    known = set(bag["block"]) | set(bag["allow"])
    want = []
    for (i, h, p, ts), act in zip(seen, acts, strict=True):
        odds = math.log(acts.count("block") / acts.count("allow")) + sum(math.log((bag["block"][t] + 1) / (sums["block"] + size)) - math.log((bag["allow"][t] + 1) / (sums["allow"] + size)) for t in ts if t in known)
        want.append((str(i), h, p, act or ("block" if odds > 0 else "allow"), round(odds, 6)))
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = [(str(r["page_id"]), r["host"], r["path"], r["verdict"], round(r["log_odds"], 6)) for r in judge(pages, URL_RULES).collect()]
    assert sorted(got) == sorted(want) and {"block", "allow"} == {w[3] for w, a in zip(want, acts, strict=True) if a is None}


def test_url_filter_keeps_words_met_once(spark):
    from sunledger.llm.url_filter import judge

    pages = spark.createDataFrame([(1, "http://quietlamp.example.org/x", "<title>quiet river lamp</title>"), (None, "http://quietlamp.example.org/x", None)], "page_id bigint, url string, html string")
    assert [list(r["tokens"][:2]) for r in judge(pages, [("block", "net/")]).collect()] == [["h:quiet", "h:lamp"]] * 2


def test_pii(spark):
    from sunledger.llm.pii import digest, find, sanitize

    texts = [None, "", "mail a.b@c.example.com, or x@y", "ip 10.0.0.255 and 300.1.1.1 1.2.3.4.5.6.7.8", "card 4111 1111 1111 1111 or 4111-1111-1111-1112", "call +1 (212) 555-0100 now +1 2", "+" * 50, "1" * 40, "a@b.c@d.ef@g.h-i.j", "é +49 30 123456789 é", "x" * 5000 + "@y.zz"]
    rows = list(enumerate(texts)) + [(2, texts[2])]
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def fine(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            s = sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(d)))
            return 13 <= len(d) <= 19 and s % 10 == 0
        return kind != "phone" or 9 <= len(d) <= 15

    want = Counter()
    for d, t in rows:
        spans = [f"{k}:{m.start()}:{m.end()}" for k, p in patterns.items() for m in re.finditer(p, t or "") if fine(k, m[0])]
        want[(d, hashlib.sha256(",".join(spans).encode()).hexdigest(), ",".join(spans))] += 1
    got = digest(find(docs(spark, rows))).collect()
    base = lambda x: ",".join(s for s in x.split(",") if s.split(":")[0] in patterns)
    assert Counter((r["doc_id"], r["base_sha256"], base(r["spans"])) for r in got) == want
    clean = {r["doc_id"]: r["text"] for r in sanitize(docs(spark, rows), remove=2, generalise=2).collect()}
    assert clean[2] == "mail [EMAIL], or x@y" and clean[0] is None and clean[9].startswith("é [PHONE]")


def test_terms_near_entities_are_scored_and_replaced(spark):
    from sunledger.llm import pii

    rows = [(i, f"some plain words {'odd' * i}\nreachme here: a{i}@b.example.com (askfor boss{i})\nand more of them") for i in range(6)]
    rows += [(100 + i, "plain words and some of them here every day " * 4) for i in range(60)] + [(None, "call +1 212 555 0100 boss1"), (None, "call +1 212 555 0100 boss1"), (300, 'key = "a1b2c3d4e5f6a7b8c9"; x = "short1", y = "onlylettersinthisvalue"'), (301, None)]
    kinds = {d: [k for k, x in (("email", "@"), ("phone", "+1"), ("secret", "key =")) if x in (t or "")] for d, t in rows}
    n, all_, both = Counter(), Counter(), Counter()
    for d, t in rows:
        n.update(kinds[d])
        all_.update({m.lower() for m in re.findall(r"\w{2,}", t or "")})
        for k, pattern in (("email", r"\S+@[a-z.]+"), ("phone", r"\+1[ 0-9]+[0-9]"), ("secret", r"(?<=key = .)[a-z0-9]{16,}")):
            near = set()
            for m in re.finditer(pattern, t or ""):
                lo, hi = max(0, m.start() - 64), min(len(t), m.end() + 64)
                for w in re.finditer(r"\w{2,}", t):
                    if (lo <= w.start() and w.end() <= m.start() and (m.start() - lo < 64 or w.start() > lo)) or (m.end() <= w.start() and w.end() <= hi and (hi - m.end() < 64 or w.end() < hi)):
                        near.add(w[0].lower())
            both.update((w, k) for w in near)
    want = {}
    for (w, k), c in both.items():
        p = n[k] / len(rows)
        want[w, k] = math.log2((c + p) / (all_[w] + 1) / p) / -math.log2(p)
    del want["onlylettersinthisvalue", "secret"]  # inside a match, though that fails its check
    prepared = pii.prepared(docs(spark, rows).select("doc_id", "text"))
    got = {(r["term"], r["kind"]): r["disclosure"] for r in pii.disclosure(prepared, pii.near_terms(pii.entities(prepared))).collect()}
    assert set(got) == set(want) and got == pytest.approx(want)
    assert got["reachme", "email"] > pii.REMOVE > got["boss3", "email"] > pii.GENERALISE > got["plain", "email"]
    text = {r["doc_id"]: r["text"] for r in pii.sanitize(docs(spark, rows)).collect()}
    assert text[3].startswith("some plain words oddoddodd\n here: [EMAIL] ( boss3)\nand ") and text[100] == rows[6][1] and text[301] is None
    assert "[SECRET]" in text[300] and "onlylettersinthisvalue" in text[300]
    spans = {(r["doc_id"], s["kind"]) for r in pii.find(docs(spark, rows)).collect() for s in r["added"]}
    assert {(3, "removed"), (300, "secret"), (None, "generalised")} <= spans


def test_cues_are_found_and_chance_neighbours_left_alone(spark):
    from sunledger.llm import pii

    rng = np.random.default_rng(12)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    common = ["".join(rng.choice(letters, rng.integers(3, 8))) for _ in range(400)]
    weight = 1 / np.arange(1, 401)

    def prose(n):  # one word in eight is new, as in real text
        return ["".join(rng.choice(letters, 9)) if rng.random() < 0.12 else str(rng.choice(common, p=weight / weight.sum())) for _ in range(n)]

    cues = {"email": ["mailbox", "inboxat"], "phone": ["callme", "dialup"], "ip": ["hostaddr", "pingnow"]}
    entity = {"email": lambda i: f"u{i}@mail.example.org", "phone": lambda i: f"+1 212 555 {1000 + i}", "ip": lambda i: f"10.0.{i % 200}.{i % 250}"}
    rows, planted = [], []
    for i in range(1500):
        words = prose(int(rng.integers(30, 90)))
        if i % 12 == 0:
            kind = list(cues)[i // 12 % 3]
            at, cue = int(rng.integers(5, 25)), cues[kind][i // 36 % 2]
            text = " ".join([*words[:at], cue, entity[kind](i), *words[at:]])
            planted.append((i, text.index(f" {cue} ") + 1))
        else:
            text = " ".join(words)
        rows.append((i, text))
    found = [(r["doc_id"], s["start"]) for r in pii.find(docs(spark, rows)).collect() for s in r["added"]]
    assert len(set(found) & set(planted)) >= 0.9 * len(planted)
    assert len(set(found) & set(planted)) >= 0.95 * len(found)


def test_suffix_dedup_joins_texts_to_its_edges_once(spark, monkeypatch):
    from sunledger.llm import suffix_dedup as S

    joined, of = [], S.per_document
    monkeypatch.setattr(S, "per_document", lambda settled, kind: joined.append(kind) or of(settled, kind))
    rng = np.random.default_rng(5)
    draw = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    line = draw(150)
    rows = [(i, draw(300) + line + draw(300)) for i in range(4)] + [(9, "")]
    rows.append((10, rows[0][1][200:500]))
    frequent = {r["doc_id"]: r["n_removed"] for r in S.suffix_dedup(docs(spark, rows), max_partners=1).collect()}
    assert joined == [1] and frequent == {0: 300, 1: 0, 2: 0, 3: 0, 9: 0, 10: 300}


@pytest.mark.parametrize("k", [1, 5, 500])
def test_top_k(spark, k):
    from sunledger.llm.topk_search import top_k

    rng = np.random.default_rng(4)
    vectors = [[float(x) for x in rng.normal(0, 0.3, 8)] for _ in range(120)]
    vectors[7] = vectors[3]
    taking = [*enumerate(vectors), (5, vectors[5]), (7, vectors[50]), (7, vectors[50])]  # repeated rows and ids, ties over blocks
    rows = [*taking, (200, None), (201, [float("nan")] * 8), (202, [float("inf")] + [0.0] * 7), (203, [None] * 8), (None, vectors[0])]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id bigint, embedding array<float>, label int, rank int")
    got = {}
    for r in top_k(table, F.col("vec_id") % 50 == 0, k, block_rows=50).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    whole = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in taking]
    for q in (0, 50, 100):
        scores = sorted((-sum(a * b for a, b in zip(whole[q][1], v, strict=True)), i) for i, v in whole if i != q)
        assert got[q] == [(i, -s) for s, i in scores[:k]]
    assert set(got) == {0, 50, 100}


def test_a_twin_of_the_query_is_a_candidate(spark):
    from sunledger.llm.topk_search import top_k

    rows = [(50, [4.0, 0.0]), (50, [5.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 2.0])]
    got = top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), F.col("vec_id") % 50 == 0, 2).orderBy("rank", "score").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(50, 1, 50, 20 * 65536), (50, 1, 50, 20 * 65536), (50, 2, 1, 4 * 65536), (50, 2, 1, 5 * 65536)]


@pytest.mark.parametrize("size", [0.3, 3e5])
def test_every_row_is_a_candidate_whatever_its_length(spark, size):
    from sunledger.llm.topk_search import top_k

    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(0, size, int(rng.choice([0, 1, 7, 8, 8, 8, 9])))]) for i in range(150)]
    rows[50], rows[100] = (50, rows[50][1][:3]), (100, [])
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    found = top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 50 == 0, 60, block_rows=20).orderBy("query_id", "rank").collect()
    for q in (0, 50, 100):
        scores = sorted((-sum(a * b for a, b in zip(whole[q][1], v, strict=False)), i) for i, v in whole if i != q)
        assert [(r["vec_id"], r["score"]) for r in found if r["query_id"] == q] == [(i, -s) for s, i in scores[:60]]


def test_bounds_that_do_not_fit_are_not_used():
    from sunledger.llm.topk_search import SortedLists

    rows = np.zeros((400, 4), np.int64)
    rows[np.arange(400), np.arange(400) % 4] = (np.arange(400) + 1) << 53  # each score fits, the sum of the lists' ends does not
    found, scores = SortedLists(rows, np.arange(400)).best(np.full(4, 2), -1, 2, -np.inf)
    assert (found.tolist(), scores.tolist()) == ([399, 398], [400 << 54, 399 << 54])


def test_lists_are_read_in_sequence_and_reading_stops():
    from sunledger.llm.topk_search import SortedLists

    rng = np.random.default_rng(2)
    rows = rng.integers(-30, 30, (4000, 6))
    rows[17] = 256
    lists = SortedLists(rows, np.arange(4000))
    query = np.array([3, 0, 2, 1, 4, 2])
    found, scores = lists.best(query, -1, 1, -np.inf)
    assert (found.tolist(), scores.tolist()) == ([17], [256 * 12])
    assert lists.entries_read < rows.size / 10 and lists.rows_resolved < 50
    assert len(lists.best(query, -1, 1, 256 * 12 + 1)[0]) == 0 and lists.entries_read == 0  # no row can reach it
    for _ in range(20):
        query = rng.integers(-9, 9, 6)
        found, scores = lists.best(query, 5, 7, -np.inf)
        want = sorted((-int(rows[i] @ query), i) for i in range(4000) if i != 5)[:7]
        assert [(-s, i) for s, i in zip(scores.tolist(), found.tolist(), strict=True)] == want


def test_language_id(spark):
    from sunledger.llm.language_id import identify, learn

    words = {"xx": "kala mala pika saku tilo".split(), "yy": "wroth gnash splint brisk churl".split()}
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(rng.choice(words[lang], 30)), lang) for i, lang in enumerate(["xx", "yy"] * 40)] + [(900, "text without a label", None)]
    train = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    test = spark.createDataFrame([(0, "Pika saku kala", 1), (1, "BRISK churl", 2), (2, None, 3), (3, "", 4), (4, "12 34 !!", 5), (5, "É", 6), (0, "Pika saku kala", 1)], "doc_id bigint, text string, score int")
    got = identify(test, learn(train)).collect()
    assert Counter((r["doc_id"], r["lang_pred"]) for r in got if r["doc_id"] != 5) == Counter({(0, "xx"): 2, (1, "yy"): 1, (2, "und"): 1, (3, "und"): 1, (4, "und"): 1})
    assert all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in identify(test, learn(train.filter("lang is null"))).collect()} == {"und"}


def test_lm_base_score_and_weighting(spark):
    from sunledger.llm.lm_scoring import score

    rows = corpus()
    words = {d: [*WORD.findall(low(t or "")), "\n"] for d, t in rows}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows}
    count = Counter(w for d, ws in words.items() if not held[d] for w in ws)
    total, distinct = sum(count.values()), len(count)
    for r in score(docs(spark, rows)).collect():
        ws = words[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(ws), sum(count[w] > 0 for w in ws), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws))
        assert r["score"] < 0


def test_language_id_against_brute_force(spark):
    from sunledger.llm.language_id import identify, learn

    rng = np.random.default_rng(12)
    words = {"xx": "kala mala PIKA süß tilo kana".split(), "yy": "wroth kala splint brisk Churl pika".split(), "zz": "été mala oeil brisk ça".split()}
    draw = lambda k, n: "".join(w + str(rng.choice([" ", ". ", "\n", "9"])) for w in rng.choice(words[k], n))
    train = [(i if i % 5 else None, draw(k, int(rng.integers(1, 6))), k) for i, k in enumerate(["xx", "yy", "zz", "xx"] * 12)]
    test = [(i, draw(k, int(rng.integers(1, 5))) + draw(j, 2)) for i, (k, j) in enumerate([("xx", "yy"), ("yy", "zz"), ("zz", "zz")] * 10)] + [(90, "é" * 3000 + " kala"), (None, "kala"), (None, "kala")]

    def grams(t):
        runs = re.findall(rb"[a-z\x80-\xff]+", re.sub(b"[A-Z]", lambda m: m[0].lower(), t.encode()))
        return [(b" " + w + b" ")[i : i + n] for w in runs for n in (3, 4, 5) for i in range(len(w) + 3 - n)]

    has = {k: {g for _, t, j in train if j == k for g in grams(t)} for k in words}
    order = ["xx", "yy", "zz"]  # most training documents first, then by name
    want = []
    for d, t in test:
        hits = [sum(g in has[k] for g in grams(t)) for k in order]
        want.append((str(d), {k for k, h in zip(order, hits, strict=True) if h == max(hits)}, round(max(hits) / max(1, len(grams(t))), 5)))  # equal hits: the false-positive rates decide
    model = learn(spark.createDataFrame(train, "doc_id bigint, text string, lang string"))
    got = identify(spark.createDataFrame([(d, t, "x") for d, t in test], "doc_id bigint, text string, lang_pred string"), model)
    found = sorted((str(r["doc_id"]), round(r["score"], 5), r["lang_pred"]) for r in got.collect())
    want = sorted((d, score, may) for d, may, score in want)
    assert [x[:2] for x in found] == [x[:2] for x in want] and all(x[2] in y[2] for x, y in zip(found, want, strict=True))


def tree_log(texts, learns, depth):
    """ln of each text by context-tree weighting, node by node."""
    from functools import cache

    count = Counter()
    for t, fine in zip(texts, learns, strict=True):
        t = b"\n" * depth + t
        for i in range(depth, len(t)):
            bits = f"{t[i]:08b}"
            for d in range(depth + 1):
                for k in range(8):
                    count[(t[i - d : i], bits[:k], bits[k])] += fine
    children = {}
    for context, bits, _ in count:
        if context:
            children.setdefault((context[1:], bits), set()).add(context)

    def kt(context, bits):
        z, o = count[(context, bits, "0")], count[(context, bits, "1")]
        return math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi)

    @cache
    def weighted(context, bits):
        if len(context) == depth:
            return kt(context, bits)
        return float(np.logaddexp(kt(context, bits), sum(weighted(c, bits) for c in children.get((context, bits), ())))) - math.log(2)

    def chance(context, bits, bit):
        out = 0.0
        for d in range(depth, -1, -1):
            c = context[len(context) - d :]
            z, o = count[(c, bits, "0")], count[(c, bits, "1")]
            own = ((o if bit == "1" else z) + 0.5) / (z + o + 1)
            share = 1.0 if d == depth else math.exp(kt(c, bits) - math.log(2) - weighted(c, bits))
            out = share * own + (1 - share) * out
        return out

    out = []
    for t in texts:
        t = b"\n" * depth + t
        bits = [f"{x:08b}" for x in t]
        out.append(sum(math.log10(chance(t[i - depth : i], bits[i][:k], bits[i][k])) for i in range(depth, len(t)) for k in range(8)))
    return out


def test_lm_score_is_context_tree_weighting(spark):
    from sunledger.llm.lm_scoring import score

    rows = [(i, t) for i, t in corpus() if len(t or "") < 500]
    texts = [" ".join(WORD.findall(low(t or ""))).encode() + b"\n" for _, t in rows]
    learns = [zlib.crc32(str(d).encode()) % 5 != 1 for d, _ in rows]
    for block_bytes in (1 << 20, 100):
        got = {r["doc_id"]: r for r in score(docs(spark, rows), block_bytes=block_bytes).collect()}
        for (d, _), t, want in zip(rows, texts, tree_log(texts, learns, 4), strict=True):
            assert got[d]["score"] == pytest.approx(want, rel=1e-9)
            assert got[d]["bits_per_byte"] == pytest.approx(-want * math.log2(10) / len(t))


def test_context_tree_is_a_distribution():
    from sunledger.llm import lm_scoring as L

    assert L.log_gamma(np.array([0.5, 3.0, 100.5])) == pytest.approx([math.lgamma(x) for x in (0.5, 3.0, 100.5)], abs=1e-9)
    assert np.exp(L.log_kt(np.array([1.0]), np.array([0.0]))) == pytest.approx([0.5])
    runs = np.array([(c << 8) | x for c in (0x61626364, 0x7A7A7A7A) for x in range(256)])
    logs = L.Tree(runs, np.random.default_rng(0).integers(0, 9, 512), 4, 2).logs(lambda r, d, chance: chance)
    assert (10 ** logs.reshape(2, 256)).sum(axis=1) == pytest.approx([1, 1])


def test_decontamination(spark):
    from sunledger.llm.decontamination import clean, matches

    rng = np.random.default_rng(8)
    syllables = ["ka", "lo", "mi", "tu", "re", "so", "vi", "na"]
    word = lambda: "".join(rng.choice(syllables, 3))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [text(40) for _ in range(6)]
    swap = items[1].split()
    swap[5], swap[20] = "other", "changed"
    rows = [(i, text(200)) for i in range(30)] + [(50, text(90) + " " + items[0].upper() + " " + text(50)), (51, text(30) + " " + " ".join(swap)), (52, None), (53, ""), (50, "no leak here " + text(50))]
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, ""), (0, items[0])], "item_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]) for r in matches(docs(spark, rows), bench).collect()}
    assert found == {(50, 0), (51, 1)}
    left = Counter(r["doc_id"] for r in clean(docs(spark, rows), bench).collect())
    assert left[50] == 1 and 51 not in left and len(left) == 33
    assert matches(docs(spark, rows), bench.limit(0)).count() == 0


def leaks(seed, steep, longest, n_items=400, n_docs=60):
    """Items that cover most words in use, and texts of which half hold one in other text, some with words changed."""
    rng = np.random.default_rng(seed)
    chance = 1 / np.arange(steep, steep + 1500.0)
    draw = lambda n: [f"w{x}" for x in rng.choice(1500, n, p=chance / chance.sum())]
    items = [draw(int(rng.integers(6, longest))) for _ in range(n_items)]
    texts = []
    for i in range(n_docs):
        text = draw(200)
        if i % 2:
            item = list(items[int(rng.integers(n_items))])
            for k in rng.choice(len(item), len(item) // 6 * (i % 3), replace=False):
                item[k] = draw(1)[0]
            at = int(rng.integers(150))
            text[at : at + len(item)] = item
        texts.append(text)
    return items, texts


def idf(often, total):
    return math.log((2 + total) / (1 + often))


def common_weight(a, b, weight):
    best = np.zeros(len(b) + 1)
    b = np.array(b)
    for w in a:
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], np.where(b == w, best[:-1] + weight(w), 0)))
    return best[-1]


def against_all_pairs(spark, items, texts):
    from sunledger.llm.decontamination import matches

    halves = [set(t[i : i + 32]) for t in texts for i in range(0, len(t), 32)]
    often = Counter(w for h in halves for w in h)
    want = set()
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            mass = sum(idf(often[w], len(halves)) for w in item)
            for g in range(0, len(t), 32):
                region = t[max(0, g - 32) : g + 96]
                if sum(idf(often[w], len(halves)) for w in item if w in region) >= 0.6 * mass and common_weight(item, region, lambda w: idf(often[w], len(halves))) >= 0.6 * mass:
                    want.add((d, i))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in matches(docs(spark, [(d, " ".join(t)) for d, t in enumerate(texts)]), bench, with_answer=0.6).collect()}
    assert len(want) > 10 and got == want


def test_decontamination_loses_no_item_in_other_text(spark):
    against_all_pairs(spark, *leaks(11, 1000, 14))


def test_decontamination_weighs_frequent_words(spark):
    against_all_pairs(spark, *leaks(11, 5, 30))


@pytest.mark.parametrize("name", ["op1_suffix_dedup", "op2_best_fit_packing", "op3_url_filter", "op4_pii", "op5_top_k_search", "op6_jaccard_join", "op7_language_id", "op8_benchmark_decontamination", "op9_lm_scoring", "op10_substring_dedup", "pipeline"])
def test_empty_tables(spark, tmp_path, name):
    from sunledger.llm.registry import QUERIES

    shapes = {"documents": "doc_id bigint, text string, lang string, source string, n_chars bigint", "pages": "page_id bigint, url string, html string", "embeddings": "vec_id bigint, embedding array<float>, label int", "benchmark": "item_id bigint, text string"}
    for table, shape in shapes.items():
        spark.createDataFrame([], shape).write.parquet(str(tmp_path / f"{table}.parquet"))
    assert QUERIES[name](spark, str(tmp_path)).count() == 0


def test_null_ids(spark):
    from sunledger.llm import jaccard_join, lm_scoring, pii, substring_dedup, suffix_dedup

    rows = [(None, corpus()[8][1]), (None, corpus()[8][1]), (1, corpus()[8][1]), (None, None)]
    for f in (suffix_dedup.suffix_dedup, substring_dedup.substring_dedup, partial(jaccard_join.jaccard_components), pii.find, lm_scoring.score):
        assert f(docs(spark, rows)).count() == 4
    assert {r["component_id"] for r in jaccard_join.jaccard_components(docs(spark, rows)).filter("n_shingles > 0").collect()} == {1}


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    now = documents
    for name, stage in corpus_pipeline.STAGES[:2]:
        after = stage(spark, now, sf_dir)
        assert after.columns == documents.columns, name
        assert 0 < after.count() <= now.count()
        now = after
    words = components_of([(r["doc_id"], r["text"]) for r in documents.collect() if re.search(r"[^\W\d_]", r["text"] or "")], 5, 80)
    assert now.count() == len({c for _, n, c in words if n}) + sum(1 for _, n, _ in words if not n)


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = np.random.default_rng(4)
    draw = lambda n: " ".join("".join(rng.choice(list("aeioklmnrst"), int(rng.integers(3, 8)))) for _ in range(n))
    base, item = draw(60), draw(30)
    near = base.split()
    near[3] = "edited"
    rows = [(None, None), (1, ""), (2, "12 34 !"), (3, base), (3, base), (4, " ".join(near)), (None, base), (None, draw(20)), (None, draw(20)), (5, draw(40) + " " + item + " " + draw(40)), (6, f"mail {draw(3)} to someone@mail.example.com {draw(30)}"), (7, draw(9000)), (8, draw(1))]
    documents = docs(spark, rows)
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    texts, now = dict(rows[7:]), documents
    left = [
        sorted(["3", "3", "4", "None", "None", "None", "5", "6", "7", "8"]),
        sorted(["3", "None", "None", "5", "6", "7", "8"]),
        sorted(["3", "None", "None", "6", "7", "8"]),
        sorted(["3", "None", "None", "6", "7", "8"]),
    ]
    for (name, stage), ids in zip(corpus_pipeline.STAGES[:-1], left, strict=True):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        assert now.columns == documents.columns and sorted(str(r["doc_id"]) for r in now.collect()) == ids, name
    kept = {r["doc_id"]: r for r in now.collect()}
    assert "[EMAIL]" in kept[6]["text"] and "someone" not in kept[6]["text"] and kept[6]["n_chars"] == len(kept[6]["text"]) and kept[7]["text"] == texts[7]
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    encode = lambda t: len(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode(t, add_special_tokens=False).ids) + 1
    assert sum(r["length"] for r in pieces) == sum(encode(r["text"]) for r in now.collect())
    assert sorted({str(r["doc_id"]) for r in pieces}) == sorted(set(left[-1]))


def test_rows_with_null_ids_are_told_apart(spark):
    """Ids and hashes as they are, but the 32 low bits of a hash of the text alone would not do: many rows, all without an id."""
    from sunledger.llm import substring_dedup, suffix_dedup
    from sunledger.llm.common import row_id, row_key

    rng = np.random.default_rng(1)
    text = lambda: " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(40))
    copy = text()
    rows = [(None, copy), (None, copy), *((None, text()) for _ in range(50))]
    keys = docs(spark, rows).select(row_id(F.col("doc_id"), F.col("text")).alias("a"), row_key(F.col("text")).alias("b"))
    assert keys.select("a").distinct().count() == keys.select("b").distinct().count() == 51
    got = suffix_dedup.suffix_dedup(docs(spark, rows)).collect()
    assert sorted(r["n_removed"] for r in got) == [0] * 50 + [len(copy)] * 2 and {r["doc_id"] for r in got} == {None}
    assert sum(r["n_removed"] for r in substring_dedup.substring_dedup(docs(spark, rows)).collect()) == 0  # null ids do not repeat each other


def test_operators_take_null_ids(spark):
    from sunledger.llm import decontamination, language_id, packing
    import public_tokenizers

    rows = [(None, corpus()[8][1]), (None, corpus()[8][1]), (None, None), (1, corpus()[8][1])]
    bench = spark.createDataFrame([(None, corpus()[8][1]), (4, "other words")], "item_id bigint, text string")
    assert [r["doc_id"] for r in decontamination.matches(docs(spark, rows), bench).orderBy(F.col("doc_id").asc_nulls_first()).collect()] == [None, None, 1]
    assert [r["doc_id"] for r in decontamination.clean(docs(spark, rows), bench).collect()] == [None]
    assert packing.pack_documents(docs(spark, rows), public_tokenizers.path("word_bpe_49k.json")).filter("doc_id is null").count() == 3
    assert language_id.identify(docs(spark, rows), language_id.learn(docs(spark, rows))).filter("doc_id is null").count() == 3
