import random

import numpy as np

from voxtide.llm import topics

NAMES = ["cooking", "law", "music", "sport"]


def words_of(text, fillers=None):
    s = topics.Scanner(fillers)
    flat = []
    ends = s.scan(text, flat)
    names = {topics.word_hash(w): w for piece in s.known for w in topics._TOKEN.findall(piece)}
    cut = [0, *ends]
    return [[names[h] for h in flat[a:b]] for a, b in zip(cut, cut[1:])]


def test_scanner():
    f = topics.filler_pattern(["um", "ừm"])
    assert words_of("@Begin\n@Languages:\tvie\n*PAR:\tTôi thấy nó .\n> It was; no!\n@End") == [["tôi", "thấy", "nó"], ["it", "was"], ["no"]]
    assert words_of("we ummm... went home. [noise] <|1.5|> The end… done", f) == [["we", "went", "home"], ["the", "end"], ["done"]]
    assert words_of("00:00:06.815 x-ray 17:20 don't") == [["x-ray", "don't"]]
    assert words_of(None) == words_of("") == words_of("12 34 ...") == []
    assert topics.filler_pattern([]) is None


def test_pieces_of_several_sentences():
    ends = np.array([10, 20, 62, 63, 75])
    assert topics.sentence_ends(ends, (10.0, 24.0)).tolist() == [10, 20, 30, 41, 52, 62, 63, 75]  # 42 words are four usual sentences
    assert topics.sentence_ends(ends, (50.0, 42.0)).tolist() == ends.tolist() and topics.sentence_ends(np.empty(0, np.int64), (1.0, 1.0)).tolist() == []


def test_usual_length(spark):
    docs = spark.createDataFrame([(1, "a b c. a b. a b c d e"), (2, None), (3, "a b c")], "k long, t string")
    assert topics.usual_length(topics.hashed(docs, "k", "t", None)) == (3.0, 3.5 + 3 * 0.75)
    assert topics.usual_length(topics.hashed(docs.limit(0), "k", "t", None)) == (1.0, 1.0)


def test_update_against_plain_loops():
    rng = np.random.default_rng(0)
    b = rng.random((12, 3)).astype(np.float32)
    docs = [rng.choice(12, rng.integers(1, 6), replace=False) for _ in range(7)]
    n = [rng.integers(1, 4, len(d)) for d in docs]
    total = np.zeros((12, 3))
    topics.expected(np.concatenate(docs), np.concatenate(n), np.array([len(d) for d in docs]), b, total, inner=4)
    want = np.zeros((12, 3))
    for ids, c in zip(docs, n):
        gamma = np.ones(3)
        for _ in range(4):
            theta = np.exp(topics._digamma(gamma) - topics._digamma(gamma.sum()[None]))
            phi = theta * b[ids]
            phi = phi / phi.sum(1, keepdims=True) * c[:, None]
            gamma = topics.ALPHA + phi.sum(0)
        np.add.at(want, ids, phi)
    assert np.allclose(total, want, rtol=1e-4) and np.isclose(total.sum(), sum(x.sum() for x in n), rtol=1e-5)


def corpus(n, seed):
    """Made-up documents: sentences about subjects, of made-up words and, one in four, an inspected one, or about nothing."""
    rng = random.Random(seed)
    own = {s: topics.TERMS[s].split()[:12] + [f"{s[:3]}word{i}" for i in range(36)] for s in NAMES}
    plain = [f"plain{i}" for i in range(40)]
    rows, truth = [], {}
    for i in range(n):
        subj = rng.sample(NAMES, rng.choice([0, 1, 1, 2]))
        sents, count = [], dict.fromkeys(NAMES, 0)
        for _ in range(rng.randrange(4, 14)):
            s = rng.choice([*subj, *subj, None]) if subj else None
            sents.append(" ".join(rng.sample(own[s] if s else plain, 4) + rng.sample(plain, 2) + ["the", "was"]))
            if s:
                count[s] += 1
        rows.append((i, ". ".join(sents) + ".", "x"))
        truth[i] = {s for s, c in count.items() if 4 * c >= len(sents)}
    return rows, truth


def test_fit_without_guidance_and_proportions(spark):
    """Subjects are found by topics, not by listed words, and by how much of a document is about them."""
    rows, truth = corpus(1000, 3)
    unlisted = (9002, ". ".join(" ".join(f"spoword{(i + j) % 36}" for j in range(4)) for i in range(8)) + ".", "x")
    passing = (9003, "the judge argued in court under oath with a witness. " + ". ".join(" ".join(f"cooword{(i + j) % 36}" for j in range(6)) for i in range(9)) + ".", "x")
    df = spark.createDataFrame([*rows, unlisted, passing, (1, rows[1][1], "x"), (9000, None, "x"), (9001, "", "x"), (None, rows[0][1], "x")], "k long, t string, share string")
    got = {}
    out = topics.subjects(df, "k", "t", NAMES).collect()
    for r in out:
        got.setdefault(r.k, set()).add(r.subject)
    assert len(out) == sum(map(len, got.values())) and not {9000, 9001, None} & set(got)
    hit = sum(len(truth[i] & got.get(i, set())) for i in truth)
    assert hit / sum(map(len, got.values())) > 0.95 and hit / sum(map(len, truth.values())) > 0.95
    assert got[9002] == {"sport"} and got[9003] == {"cooking"}


def test_empty_tiny_and_long(spark):
    schema = "k long, t string"
    assert topics.subjects(spark.createDataFrame([], schema), "k", "t", NAMES).count() == 0
    assert topics.subjects(spark.createDataFrame([(1, "one")], schema), "k", "t", NAMES).count() == 0
    assert topics.subjects(spark.createDataFrame([(1, "court judge. " * 100_000), (2, "dough oven. " * 10)], schema), "k", "t", ["nothing known"]).count() == 0


def test_inner_updates_come_near_their_fixed_point():
    rng = np.random.default_rng(0)
    b = rng.gamma(0.1, 1.0, (60, 24)).astype(np.float32) + 1e-4
    b /= b.sum(0)
    docs = [rng.choice(60, rng.integers(3, 30), replace=False) for _ in range(200)]
    n = [rng.integers(1, 4, len(d)) for d in docs]
    ids, n, lengths = np.concatenate(docs), np.concatenate(n), np.array([len(d) for d in docs])
    got, want = np.zeros((60, 24)), np.zeros((60, 24))
    topics.expected(ids, n, lengths, b, got)
    topics.expected(ids, n, lengths, b, want, inner=300)
    assert np.abs(got - want).sum() < 0.12 * want.sum()  # 0.16 after three updates, 0.09 after eight


def test_terms_have_no_upper_limit(spark):
    """Terms in few documents go; common ones stay and weigh less, one of all documents weighs nothing."""
    rows = [(i, "all. " + ("often. " if i % 4 else "") + " ".join(f"fill{(i + j) % 900}." for j in range(20)) + (" rare" if i < 4 else "")) for i in range(900)]
    words = topics.hashed(spark.createDataFrame(rows, "k long, t string"), "k", "t", None)
    n = {r.term: r.n for r in topics.document_frequencies(words).collect()}
    assert n[topics.word_hash("often")] == 675 and n[topics.word_hash("rare")] == 4
    m = topics.fit(words, NAMES, most_rounds=1)
    weight = dict(zip(m.terms.tolist(), m.idf.tolist()))
    assert len(weight) == 901 and not {topics.word_hash("rare"), topics.word_hash("all")} & set(weight)
    assert weight[topics.word_hash("often")] < 0.3 < 3 < weight[topics.word_hash("fill7")]


def test_top_terms_give_the_subject():
    terms = np.sort([topics.word_hash(w) for w in ("court", "judge", "dough", "stove", "plain", "other")])
    at = {w: int(np.searchsorted(terms, topics.word_hash(w))) for w in ("court", "judge", "dough", "stove", "plain", "other")}
    p = np.full((6, 4), 0.02)
    for k, ws in enumerate((("court", "judge"), ("dough", "stove"), ("plain", "other"), ("court", "dough"))):
        p[[at[w] for w in ws], k] = 0.46
    assert topics.topic_subjects(p, p.mean(1), terms, NAMES).tolist() == [NAMES.index("law"), NAMES.index("cooking"), -1, -1]
