"""The prefix trie, the licence scan and the phrases against brute force, with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from groundwell.llm import licenses, phrases, prefix_trie
from groundwell.llm.common import table


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# conversations


def trie_by_hand(rows):
    """rows (conv_id, turn, role, text) to the set of nodes."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append(((turn is not None, turn or 0, digest), (role, text)))
    turns = {c: [x for _, x in sorted(t)] for c, t in own.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = tuple(turns.get(base, [])[:h] + turns[c][h:])
    members = defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    children = Counter(s[:-1] for s in members if s)
    leaves, saved = Counter(), Counter()
    for s, m in members.items():
        gain = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) if s else 0
        for d in range(len(s) + 1):
            leaves[s[:d]] += not children[s]
            saved[s[:d]] += gain
    ends = lambda s, m: hashlib.sha256(",".join(str(c) for c in sorted(m) if built[c] == s).encode()).hexdigest()
    return {(min(m), len(s), min(members[s[:-1]]) if s else None, len(m), children[s], leaves[s], saved[s], ends(s, m)) for s, m in members.items()}


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_rows(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, words string, place int")
    got = [tuple(r[c] for c in TRIE) for r in prefix_trie.trie(df).collect()]
    assert len(got) == len(set(got))
    return set(got)


def talks(seed, n=90):
    rng = random.Random(seed)
    rows = []
    for c in [*range(n), 4000, 4007, 100_000_000_019, -3, -40]:
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, t, rng.choice(["user", "user", "assistant"]), rng.choice(["hello there", "yes", "a b c", "one two three four"])))
    rows += [(5, None, None, None), (5, None, "user", ""), (6, 2, "user", "again"), (6, 2, "user", "again"), (None, 1, "user", "lost"), (7, 50, "user", "w " * 5000)]
    rows += [(c, t, "user", "same start") for c in range(200, 320) for t in range(4)]  # copies
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("piece", "shard"), [(64, 200_000), (64, 12), (2, 9)])
def test_trie_by_brute_force(spark, monkeypatch, piece, shard):
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    monkeypatch.setattr(prefix_trie, "SHARD", shard)
    rows = talks(3)
    assert trie_rows(spark, rows) == trie_by_hand(rows)


def test_trie_small_tables(spark):
    assert trie_rows(spark, []) == set()
    lone = [(3, 0, "user", "a b")]  # h of 3 turns at most; the family's first is absent, so few have turns left
    assert trie_rows(spark, lone) == trie_by_hand(lone)
    assert trie_rows(spark, [(None, 0, "user", "a")]) == set()


def test_search_tree_is_balanced():
    tree = prefix_trie.SearchTree()
    n = 1023
    for i in prefix_trie.middle_first(n):
        tree.insert([i, 7], [0, 1])
    depth = [0] * len(tree.split)
    for x in range(len(tree.split)):
        for side in (tree.low[x], tree.high[x]):
            if side >= 0:
                depth[side] = depth[x] + 1
    assert max(depth) == 9 and sorted(prefix_trie.middle_first(n)) == list(range(n)) and len(tree.split) == 2 * n


# licences


def base_by_hand(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))
    places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + p.count(" ") + 1] == p.split()]
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def noise(rng, n):
    return " ".join(rng.choice(["lorem", "ipsum", "the", "of", "and", "software", "copy", "Straße", "x1"]) for _ in range(n))


def licence_texts():
    rng = random.Random(8)
    header = {t.name: t.text for t in licenses.TEMPLATES}
    mit = header["mit-permission"]
    return {
        1: None, 2: "", 3: " \t\n", 4: "Licensed under CC BY-NC 4.0.", 5: "cc by cc by CC-BY; cc  by", 6: "mit licenses MIT-License mit license", 7: "the Kit license", 8: "MİT license mit lıcense",
        9: noise(rng, 400) + "\n" + mit + "\n" + noise(rng, 300), 10: mit.replace("free of charge", "at a price"), 11: " ".join(rng.sample(mit.split(), len(mit.split()))),
        12: " ".join([noise(rng, 50), header["bsd-conditions"], noise(rng, 50), header["gpl-header"], noise(rng, 9), header["gpl-notice"]]), 13: "// " + header["apache-header"].replace(" ", "\n * "),
        14: "apache license " * 3000, 15: header["mpl-header"], 16: header["isc-permission"], 17: "GNU General Public License, version 2", 18: noise(rng, 20_000) + " Apache License", 19: "permission is hereby granted free of charge to deal in the software without restriction",
    }


def test_licences(spark):
    texts = licence_texts()
    rows = [*texts.items(), (4, texts[4]), (None, texts[16])]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, hits string, row_id int")
    got = licenses.license_scan(df).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == Counter((i, *base_by_hand(t)) for i, t in rows)
    labels = {r.doc_id: r.labels for r in got}
    assert labels[4] == "cc-by,cc-by-nc" and labels[9] == "mit" and labels[10] == labels[11] == labels[19] == "" and labels[12] == "bsd,gpl,gpl-3" and labels[13] == "apache-2.0"
    assert (labels[14], labels[15], labels[16], labels[17], labels[18], labels[None]) == ("apache", "mpl-2.0", "isc", "gpl", "apache", "isc")
    score = {r.doc_id: r.score for r in got}
    assert score[1] == score[2] == score[11] == 0.0 and score[14] == 0.5 and score[9] == score[16] == 1.0 and all(0 <= r.score <= 1 for r in got)


def test_licences_of_nothing(spark):
    assert licenses.license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# phrases


def phrases_by_hand(docs, top=phrases.TOP):
    f = Counter()
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", ascii_lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            f.update((lang or "und", tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    n = Counter()
    for (lang, w), c in f.items():
        n[lang] += c * (len(w) == 1)
    found = [(lang, w, a) for (lang, w), a in f.items() if len(w) > 1 and a >= phrases.LEAST]
    longest = Counter()
    for lang, w, a in found:
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                key = lang, w[i : i + k]
                longest[key] = max(longest[key], a)
    by = defaultdict(list)
    for lang, w, a in found:
        if 100 * longest[lang, w] < 80 * a:
            score, _, x, y = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            by[lang].append((-score, -a, " ".join(w).encode(), x, y))
    return {(lang, rank, p.decode(), -a, x, y, n[lang], -s) for lang, rows in by.items() for rank, (s, a, p, x, y) in enumerate(sorted(rows)[:top], 1)}


def phrase_texts():
    rng = random.Random(4)
    words = ["the", "a", "of", "Big", "big", "data", "x\x01", "é", "\x7f", "zz"]
    docs = [(rng.choice(["en", "en", "de", None, "und"]), " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) + rng.choice([".", "", "\n", "; ,"]) + "New York City Hall is far, Hong Kong") for _ in range(150)]
    docs += [("en", "one long passage that stands in many documents word for word")] * 45
    docs += [("de", "a a a a a a a a")] * 20 + [("en", None), ("fr", ""), (None, None), ("fr", "  \t . ,"), ("en", "solo"), ("en", "hot pair " + "hot pair ".join(f"w{k} v{k} " for k in range(200)))]
    return docs


PHRASE = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize(("size", "top"), [(6 << 20, 2000), (300, 2000), (40, 5)])
def test_phrases_by_brute_force(spark, monkeypatch, size, top):
    monkeypatch.setattr(phrases, "RANGE", size)
    docs = phrase_texts()
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "lang string, text string, phrase string, n int")
    got = [tuple(r[c] for c in PHRASE) for r in phrases.collocations(df, top).collect()]
    assert len(got) == len(set(got)) and set(got) == phrases_by_hand(docs, top)


def test_phrases_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert phrases.collocations(spark.createDataFrame([("en", None), (None, " ")], "lang string, text string")).count() == 0


def test_windows_and_blocks(monkeypatch):
    assert phrases.windows(b"A b\tC  d e. F").to_pylist() == [b"a b c d ", b"b c d e ", b"c d e ", b"d e ", b"e ", b"f "]
    assert phrases.windows(b" ,.\n").to_pylist() == []
    monkeypatch.setattr(phrases, "FLUSH", 8)
    text = b"one two. three four five six, seven\neight nine ten eleven twelve"
    assert [w for b in phrases._cut(text) for w in phrases.windows(b).to_pylist()] == phrases.windows(text).to_pylist()


def test_compacted_paths(spark):
    """A chain of words, a circle, and a fork."""
    chain = [f"w{k}" for k in range(600)]
    circle = ["p", "q", "r", "s", "t"]
    grams = [tuple(chain[i : i + 4]) for i in range(len(chain) - 3)] + [tuple(circle[(i + j) % 5] for j in range(4)) for i in range(5)] + [("f", "o", "r", x) for x in "ab"]
    edges = spark.createDataFrame([("en", " ".join(g), 100 + i) for i, g in enumerate(grams)], "lang string, phrase string, f long")
    paths = phrases.compacted(edges).collect()
    assert sorted(len(p.weights) for p in paths) == [1] * 7 + [597 - 2 * phrases.PATH_PIECE, phrases.PATH_PIECE, phrases.PATH_PIECE]
    want = defaultdict(int)
    for i, g in enumerate(grams):
        for k in (2, 3):
            for j in range(5 - k):
                want[" ".join(g[j : j + k])] = max(want[" ".join(g[j : j + k])], 100 + i)
    got = defaultdict(int)
    for r in phrases.covered(spark.createDataFrame(paths, phrases.compacted(edges).schema)).collect():
        got[r.phrase] = max(got[r.phrase], r.longer)
    assert got == want


def test_registered_queries_against_sql(spark, sf_dir):
    import duckdb

    from groundwell.llm import queries

    con = duckdb.connect()
    for name in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    for q in ("op11_prefix_trie", "op12_licenses", "op13_phrases"):
        got = queries.QUERIES[q](spark, sf_dir)
        want = con.sql(queries.ORACLE_SQL[q])
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=str) == sorted(want.select(*cols).fetchall(), key=str)
    assert table(spark, sf_dir, "documents").count() > 0
