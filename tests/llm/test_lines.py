import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa

from ridgeline.llm import lines
from ridgeline.llm.common import hash_words, mix64, utf8

MASK = (1 << 64) - 1


def mixed(x):
    return int(mix64(np.array([x & MASK], np.uint64))[0])


def boundaries(raw):
    """Words, and the first word and hash of each chunk, one place at a time."""
    words = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    h = [int(hash_words(np.frombuffer(raw[a:b], np.uint8), np.array([b - a]))[0]) for a, b in words]
    line = [i == 0 or b"\n" in raw[words[i - 1][1] : words[i][0]] or raw[words[i - 1][1] - 1] in b".!?" for i in range(len(words))]
    flagged = [mixed(v + int(lines.FACTOR) * x) for v, x in zip(h, line)]
    n = len(words) - lines.CHUNK + 1
    xs, values = [], []
    for i in range(n):
        total = sum(flagged[i + k] * pow(lines.BASE, k, 1 << 64) for k in range(1, lines.CHUNK))
        xs.append(mixed(total + mixed(h[i])))
        values.append(xs[-1] >> 1 | (not line[i]) << 63)
    chosen = set()
    for at in range(max(1, n - lines.NEAR + 1) if n > 0 else 0):
        near = values[at : at + lines.NEAR]
        chosen |= {at + k for k, v in enumerate(near) if v == min(near)}
    out = []
    chosen = sorted(chosen)
    for k, i in enumerate(chosen):
        if not (k and values[chosen[k - 1]] == values[i] and i - chosen[k - 1] < lines.NEAR):
            out.append((i, xs[i]))
    return words, out


def brute(rows, copies=None):
    docs = sorted({(k, t or "") for k, t in rows if k is not None})
    cut = {d: boundaries(d[1].encode()) for d in docs}
    places = defaultdict(list)
    for d in docs:
        for ordinal, (_, x) in enumerate(cut[d][1]):
            places[x].append((d, ordinal))

    first_of = lambda d, k: min(places[cut[d][1][k][1]]) if 0 <= k < len(cut[d][1]) and len(places[cut[d][1][k][1]]) > 1 else None

    def known(d, ordinal):
        words, chunks = cut[d]
        at, reach = chunks[ordinal][0], lines.NEAR - 1
        first, k = first_of(d, ordinal)
        own = (first, k) == (d, ordinal)
        lo = max(0, at - reach, min(at, chunks[ordinal - 1][0] + lines.CHUNK) if not own and first_of(d, ordinal - 1) == (first, k - 1) else 0)
        hi = min(len(words), at + lines.CHUNK + reach, max(at + lines.CHUNK, chunks[ordinal + 1][0]) if not own and first_of(d, ordinal + 1) == (first, k + 1) else len(words))
        return d[1].encode(), words, at, lo, hi

    gone = defaultdict(set)
    for x, some in places.items():
        assert len({d[0] for d, _ in some}) == len({d for d, _ in some})  # ids decide the order here
        some.sort()
        if len(some) == 1:
            continue
        first, o = some[0]
        raw, words, at, lo, hi = known(first, o)
        for d, ordinal in some[1:]:
            raw2, words2, at2, lo2, hi2 = known(d, ordinal)
            text = lambda r, w, i, j: r[w[i][0] : w[j - 1][1]] if i < j else b""
            if text(raw, words, at, at + lines.CHUNK) != text(raw2, words2, at2, at2 + lines.CHUNK):
                continue
            a = b = 0
            while at - a > lo and at2 - a > lo2 and text(raw, words, at - a - 1, at + 1) == text(raw2, words2, at2 - a - 1, at2 + 1):
                a += 1
            end, end2 = at + lines.CHUNK, at2 + lines.CHUNK
            while end + b < hi and end2 + b < hi2 and text(raw, words, at, end + b + 1) == text(raw2, words2, at2, end2 + b + 1):
                b += 1
            gone[d].add((words2[at2 - a][0], words2[end2 + b - 1][1], first[0], len(words)))
    out = []
    for k, t in rows:
        raw = (t or "").encode()
        spans = gone.get((k, t or ""), set())
        for other, n in {x[2:] for x in spans}:
            covered = {i for a, b, o, _ in spans if o == other for i, (u, v) in enumerate(cut[k, t][0]) if a <= u and v <= b}
            if copies is not None and len(covered) >= copies * (len(cut[k, t][0]) + n - len(covered)):
                spans = set()
                break
        spans = lines.merged([x[:2] for x in spans], raw)
        out.append((k, lines.without(raw, spans).decode() if spans else t, len(spans)))
    return sorted(out, key=str)


def sentence(rnd):
    return " ".join("".join(rnd.choices("aeinrst", k=rnd.randint(1, 7))) for _ in range(rnd.randint(3, 12))).capitalize() + "."


def corpus(seed, n=60):
    rnd = random.Random(seed)
    passages = [" ".join(sentence(rnd) for _ in range(10)) for _ in range(3)] + ["\n".join(sentence(rnd) for _ in range(9))]
    rows = []
    for i in range(n):
        parts = [sentence(rnd) + rnd.choice([" ", "\n"]) for _ in range(rnd.randint(0, 15))]
        for p in passages:
            if rnd.random() < 0.4:
                parts.insert(rnd.randint(0, len(parts)), p + rnd.choice([" ", "\n", "\n\n"]))
        rows.append((i, "".join(parts)))
    return rows, passages


def test_boundaries_equal_brute_force():
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(["ab", "c", "é🎉", ".", "!", "\n", " ", " ", "\t"]) for _ in range(rnd.randint(0, 400))) for _ in range(60)]
    texts += [None, "", " \n", "a " * 200, "a b " * 100, "x" * 300 + " " + "y " * 50, "one two", " ".join(f"w{i}" for i in range(lines.CHUNK)), " ".join(f"w{i}" for i in range(lines.CHUNK - 1))]
    c = lines.cut(texts)
    for i, t in enumerate(texts):
        lo, hi = c.range_of(i)
        words, want = boundaries((t or "").encode())
        got = [(int(w) - int(c.first[i]), int(x)) for w, x in zip(c.chunks[lo:hi], c.x[lo:hi])]
        assert got == want, t
        assert [(int(a - c.offsets[i]), int(b - c.offsets[i])) for a, b in zip(c.starts[c.first[i] : c.last[i]], c.ends[c.first[i] : c.last[i]])] == words


def test_bytes_of_a_column():
    column = pa.array(["é", None, "", "ab", "c"]).slice(1, 3)
    data, offsets = utf8(column)
    assert data.tobytes() == b"ab" and offsets.tolist() == [0, 0, 0, 2]
    assert utf8(pa.array([], pa.string()))[1].tolist() == [0]


def test_boundaries_resist_shifts():
    """A passage of CHUNK + NEAR - 1 words holds a chunk that the words around it don't change."""
    rnd = random.Random(2)
    for _ in range(100):
        word = lambda: "".join(rnd.choices("abcdefgh", k=6)) + rnd.choice(["", "", "", "", ".", "\n"])
        passage = " ".join(word() for _ in range(lines.CHUNK + lines.NEAR - 1))
        found = []
        for _ in range(2):
            before, after = (" ".join(word() for _ in range(rnd.randint(1, 90))) for _ in range(2))
            c = lines.cut([f"{before}. {passage} {after}"])
            lo = len(before.split())
            found.append({int(x) for w, x in zip(c.chunks, c.x) if lo <= w and w + lines.CHUNK <= lo + len(passage.split())})
        assert found[0] & found[1]


def test_equal_ends_and_starts():
    assert lines.equal_ends(b"one two three ", b"x two three ") == len(b"two three ")
    assert lines.equal_ends(b"atwo three ", b"two three ") == len(b"three ")
    assert lines.equal_ends(b"", b"a ") == 0 and lines.equal_ends(b"a b ", b"a b ") == 4
    assert lines.equal_starts(b" one two", b" one twofold") == len(b" one")
    assert lines.equal_starts(b" one two", b" one two more") == len(b" one two")
    assert lines.equal_starts(b"\none", b" one") == 0 and lines.equal_starts(b" a", b"") == 0


def test_equals_brute_force(spark):
    rows, passages = corpus(3)
    rows += [(70, rows[0][1]), (70, rows[0][1]), (71, None), (72, ""), (None, rows[1][1]), (73, " \n "), (74, rows[9][1]), (75, "tab\t" * 50), (76, " ".join(passages[0].split()))]
    df = spark.createDataFrame([(k, t, 1, "s", 2) for k, t in rows], "doc_id long, text string, id int, h string, x int").repartition(3)
    got = lines.dedup(df, "doc_id", "text")
    assert got.columns == ["doc_id", "text", "id", "h", "x", "n_removed", "left_share"]
    result = [(r.doc_id, r.text, r.n_removed) for r in got.collect()]
    assert sorted(result, key=str) == brute(rows)
    for p in passages:
        assert sum(p in (t or "") for _, t, _ in result) <= 2  # the first, and a row without an id
    assert lines.dedup(df.limit(0), "doc_id", "text").count() == 0


def test_hot_chunks(spark, monkeypatch):
    """One passage in 3,000 documents: its chunks are compared where they are."""
    monkeypatch.setattr(lines, "SOME", 1000)
    rnd = random.Random(21)
    passage = " ".join(sentence(rnd) for _ in range(8))
    rows = [(i, f"own{i} words{i} of{i} text{i}. {passage} end{i} of{i} it{i}.") for i in range(3000)]
    got = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(i, t if i == 0 else f"own{i} words{i} of{i} text{i}. end{i} of{i} it{i}.") for i, t in rows]


def test_texts_of_one_id(spark):
    rnd = random.Random(22)
    passage = " ".join(sentence(rnd) for _ in range(12))
    rows = [(1, f"First one here. {passage}"), (1, f"Another text there. {passage} It ends."), (1, f"First one here. {passage}"), (0, "Nothing to see.")]
    got = [r.text for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()]
    assert len(got) == 4 and sum(passage in t for t in got) in (1, 2) and {w for t in got for w in t.split()} == {w for _, t in rows for w in t.split()}


def test_line_ends_stay():
    assert lines.without(b"One. Two.\nThree.", [(5, 10)]) == b"One. \nThree."
    assert lines.without(b"One.\nTwo.\nThree.", [(5, 10)]) == b"One.\nThree."
    assert lines.without(b"One. Two. Three.", lines.merged([(0, 4), (5, 9)], b"One. Two. Three.")) == b"Three."
    assert lines.merged([(3, 5), (0, 4)], b"ab cd \n ef") == [(0, 8)]


def test_query_equals_brute_force(spark):
    from ridgeline.llm.queries import op4_lines

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(((r.doc_id, r.text, r.n_removed) for r in op4_lines(spark, sf).collect()), key=str)
    assert got == brute(rows) and sum(r[2] for r in got) > 0


def test_texts_without_repeats_stay(spark):
    rnd = random.Random(11)
    rows = [(i, "".join(f"{sentence(rnd)[:-1]} w{i}x{j}." + rnd.choice([" ", "\n"]) for j in range(i % 25))) for i in range(150)]
    rows.append((150, "One two three four five six. Seven eight nine ten eleven twelve."))
    got = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    assert sorted((r.doc_id, r.text) for r in got) == rows and not any(r.n_removed for r in got)


def test_every_line_stays_somewhere(spark):
    rows, passages = corpus(12)
    rows.append((60, "\n".join(passages + [rows[3][1]] + passages[::-1])))
    got = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    left = {w for r in got for w in r.text.split()}
    assert left == {w for _, t in rows for w in t.split()}


def test_passages_of_50_to_80_words(spark):
    """In one to six lines, on lines of their own or in the middle of one: the second copy goes whole, and nothing else does."""
    rnd = random.Random(13)
    word = lambda: "".join(rnd.choices("abcdefghijklmnop", k=7))
    rows, passages = [], []
    for size in (50, 60, 80):
        for n in range(1, 7):
            ends = {size * (i + 1) // n - 1 for i in range(n)}
            for middle in (False, True):
                passages.append([word() + ("." if i in ends and not (middle and i == size - 1) else "") for i in range(size)])
                for _ in range(2):
                    before, after = (" ".join(word() for _ in range(30)) for _ in range(2))
                    rows.append((len(rows), f"{before}{'' if middle else '.'} {' '.join(passages[-1])} {after}."))
    got = {r.doc_id: r.text for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    for i, p in enumerate(passages):
        assert got[2 * i] == rows[2 * i][1]
        assert got[2 * i + 1] == rows[2 * i + 1][1].replace(" ".join(p) + " ", "")


def test_copies_left_whole(spark):
    rnd = random.Random(14)
    base = [sentence(rnd) for _ in range(30)]
    edited = list(base)
    edited[15] = "Something else altogether."
    passage = " ".join(base[:7])
    other = " ".join(sentence(rnd) for _ in range(30))
    rows = [(0, " ".join(base)), (1, " ".join(edited)), (2, " ".join(base)), (3, f"{passage} {other}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.dedup(df, "doc_id", "text", copies=0.5).collect()}
    assert [got[i] for i in range(3)] == [t for _, t in rows[:3]] and got[3] == other
    every = {r.doc_id: (r.text, r.left_share) for r in lines.dedup(df, "doc_id", "text").collect()}
    assert every[2] == ("", 0.0) and "Something else" in every[1][0] and 0 < every[1][1] < 0.1 and every[0][1] == 1.0


def test_columns_of_any_name(spark):
    """Helper names are ones that the table doesn't have."""
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(i, f"{i} start {text}", "a", i, "b", 2.5) for i in range(4)]
    df = spark.createDataFrame(rows, "id long, t string, _dedup_k string, _dedup_id int, _DEDUP_H string, _dedup_gone double")
    got = lines.dedup(df, "id", "t")
    assert got.columns == [*df.columns, "n_removed", "left_share"]
    assert sorted(r.n_removed for r in got.collect()) == [0, 1, 1, 1]
