import random

import pytest

from skylathe.llm import truncation as M
from skylathe.llm.truncation import _body, _goes_on, _tail, strict_prefixes, tail_statistics, truncated

SUBJECTS = ["The oil cooler", "The front magneto", "A spare drain plug", "The mechanic", "Our inspector"]
TAILS = ["was replaced after the second flight", "began to smell of hot oil during the climb", "showed a crack along the lower weld", "had been tightened without a torque wrench", "signed the card before the shift ended"]


def corpus(n=300, seed=1):
    rnd = random.Random(seed)
    sent = lambda: f"{rnd.choice(SUBJECTS)} {rnd.choice(TAILS)}"
    rows, cut = [], set()
    for i in range(n):
        text = ". ".join(sent() for _ in range(rnd.randint(2, 5)))
        kind = rnd.choice(["full", "full", "bare", "signed", "cut", "hyphen", "dots", "list"])
        if kind == "full":
            text += "."
        elif kind == "signed":
            text += ".\nCard closed"
        elif kind == "list":
            text += ":\n- [x] drain plug checked\n- [ ] oil cooler replaced"
        elif kind in ("cut", "hyphen", "dots"):
            words = text.split(" ")
            w = words[-rnd.randint(1, 3)]
            at = len(text) - len(words[-1]) - rnd.choice([0, 0, 4]) if len(w) < 4 else text.rindex(w) + len(w) // 2
            text = text[:at].rstrip(" .") + {"cut": "", "hyphen": "-", "dots": "..."}[kind]
            if kind == "hyphen" and not text[-2].isalnum():
                text = text[:-2] + "-"
            cut.add(i)
        rows.append((i, text, "s1", 3))
    return rows, cut


def found(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, key int")
    return {r["doc_id"] for r in truncated(df).filter("cut").collect()}


def test_corpus(spark):
    rows, cut = corpus()
    got = found(spark, rows)
    assert len(got & cut) >= 0.97 * len(cut)
    assert len(got - cut) <= 0.02 * len(rows)


def test_copies_do_not_vouch_for_each_other(spark):
    # seen elsewhere only inside sentences and as the beginning of a longer word
    others = [(i, f"On day {i} the oil cooler was {w} and signed off.", "s", 1) for i, w in enumerate(["replaced", "replanted", "replaced", "replaced", "replated"])]
    copies = [(100 + i, "Again the oil cooler was repla" + ("", " ", "\n")[i % 3], "t", 1) for i in range(12)]
    bare = [(200 + i, f"{who} found that it was all in good order", "u", 1) for i, who in enumerate(["They", "We", "Stores", "Crews"])]
    assert found(spark, others + copies + bare) == {r[0] for r in copies}


def test_limits_decide_unknown_tails(spark):
    rnd = random.Random(2)
    odd = lambda n: ("".join(rnd.choice("bcdfghjklmnpqrstvwxz") for _ in range(9)) + " ") * (n // 10 + 1)
    rows = [(i, odd(80)[:80].rstrip() + "x" * (80 - len(odd(80)[:80].rstrip())), "short", 1) for i in range(8)]
    rows = [(i, (odd(200)[:79] + "q")[:80], "short", 1) for i in range(8)] + [(100 + i, odd(40 + 11 * i).strip() + ".", "short", 1) for i in range(20)]
    assert set(range(8)) <= found(spark, rows)


@pytest.mark.parametrize(
    ("text", "kind"),
    [("Done.", "none"), ("Done.  \n", "none"), ("Why?", "none"), ("the wor", "word"), ("the wor-", "word"), ("and then,", "signs"), ("x\n10.", "signs"), ("- [x] a\n- [ ]", "signs"), ("said “so.”", "none"), ("ok ✅", "signs"), ("<p>x.</p>", "signs"), ("", "none"), ("…", "none"), ("(see", "word"), ("value <", "signs"), ("50%", "signs")],
)
def test_kinds(text, kind):
    assert _tail(_body(text)[0])[0] == kind


def test_signs_are_cut_only_by_evidence(spark):
    odd = ["The share rose to a total of 50%", "Written in C#", "Price in dollars: 100 $", "It held,", "| a | b |\n| 1 |", "Set to <", "x\n10.", "Then the hose-"]
    assert found(spark, [(i, t, "s", 1) for i, t in enumerate(odd)]) == set()
    # what the corpus goes on behind, and what it ends with
    more = [(100 + i, f"On day {i} it held, then it broke. The gauge read {i} % and stayed there.", "s", 1) for i in range(8)]
    more += [(200 + i, f"The loss came to {i}%", "s", 1) for i in range(4)]
    more += [(300, "The seal held,", "s", 1), (301, "The gauge read 9 %", "s", 1), (302, "The loss came to 61%", "s", 1)]
    assert found(spark, more) == {300, 301}


def text_rows(spark, texts, parts=None):
    df = spark.createDataFrame([(M._text_hash(t), t) for t in texts], "h binary, text string")
    return df.repartition(parts) if parts else df


def prefixes(spark, texts):
    name = {M._text_hash(t): t for t in texts}
    return {name[bytes(r["h"])] for r in strict_prefixes(text_rows(spark, texts)).collect()}


def test_prefixes(spark):
    texts = ["abc", "abc def", "abc.", "abc.\nCard", "ab", "x", "x", "yy\nz", "yy", "p. More", "p", "q.", "q"]
    assert prefixes(spark, texts) == {"abc", "ab", "p"}
    assert strict_prefixes(text_rows(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("parts", range(1, 9))
@pytest.mark.parametrize("broadcast", [True, False])
def test_no_link_is_lost_at_a_border(spark, monkeypatch, parts, broadcast):
    if not broadcast:
        monkeypatch.setattr(M, "BROADCAST_ROWS", 0)
    texts = ["abc", "abc\nCard", "abc def"] + (["a", "ab\nx", "ab\ny", "ab\nz", "abd"] if parts > 4 else [])
    want = {t for t in texts if any(_goes_on(t, x) for x in texts if x.startswith(t) and x != t)}
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # keeps the ranges apart
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        assert prefixes(spark, texts) == want
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def brute_statistics(bodies):
    """Places of each (context, word) and of the prefixes of its words, one by one."""
    n = {}
    for body in bodies:
        words, gaps, breaks = M._read(body)
        follow = [M._follow(g, b, i == len(gaps) - 1) for i, (g, b) in enumerate(zip(gaps, breaks))]
        run = [x for w, b, f in zip(words, breaks, follow) for x in ([(w, f), ("¶", 4)] if b else [(w, f)])]
        words = [w for w, _ in run]
        for i, (w, f) in enumerate(run):
            for j in range(min(M.CONTEXT, i) + 1):
                c = tuple(words[i - j : i])
                kind = ("", "ends", "inside", "last", "")[f]
                for what, k in [(w, kind)] + ([(w[:m], "longer") for m in range(1, len(w))] if w not in "0¶" else []):
                    if k:
                        n.setdefault((c, what), dict.fromkeys(("longer", "ends", "inside", "last"), 0))[k] += 1
    return n


@pytest.mark.parametrize("most", [29, 10])
def test_statistics_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(M, "BITS_MOST", most)  # 2^10 bits: the hashes are divided and the texts read several times
    monkeypatch.setattr(M, "BITS_LEAST", min(most, M.BITS_LEAST))
    rows, _ = corpus(60, seed=5)
    bodies = sorted({_body(t)[0] for _, t, _, _ in rows} | {"a" * 40 + " the " + "b" * 30})
    tails = [(b, *_tail(b)) for b in bodies]
    tails = [t for t in tails if t[1] == "word"]
    df = spark.createDataFrame([(list(c), list(k)) for _, _, c, k, _ in tails], "contexts array<bigint>, keys array<bigint>")
    got = {r["k"]: (r["longer"], r["ends"], r["inside"], r["last"]) for r in tail_statistics(spark.createDataFrame([(b,) for b in bodies], "body string"), df).collect()}
    want = brute_statistics(bodies)
    checked = 0
    for body, _, _, keys, _ in tails:
        words, _, breaks = M._read(body)
        words = [x for w, b in zip(words, breaks) for x in ((w, "¶") if b else (w,))]
        for j, k in enumerate(keys):
            w = want[tuple(words[len(words) - 1 - j : len(words) - 1]), words[-1]]
            assert got.get(k, (0, 0, 0, 0)) == (w["longer"], w["ends"], w["inside"], w["last"])
            checked += 1
    assert checked > 100


def test_longer_copies_decide_for_every_end(spark):
    pairs = [
        ("Turn the line (see figure 4, item 53)", " before you lift it.", True), ("Order part No.", " 5 again.", True), ("It took 24.", "5 quarts.", True), ("They called it “so”", " and left.", True), ("Wash it. Dry it.", " 3. Fit it.", False), ("All was dry.", " aargh again.", False), ("Add 3 %", " of oil.", True),
        ("| a | b |", " c |\n|---|---|---|", True), ("The plug (old one.)", ", was worn.", True), ("Cut \n", "in transfer.", True), ("Held (by hand) \n", "Next item.", False), ("Washed it  ", "twice.", True), ("Held by the...", "", True), ("Held by the clamp.", "", False),
        ("All was normal.", " A spare pump was ordered.", False), ("Why was it hot?", "\nNobody knows.", False), ("He said “no.”", " “Yes” was better.", False), ("<p>Fine.</p>", " <p>Then not.</p>", False), ("Sealed!", "!!", False),
    ]
    rows = [(i, a, "s", 1) for i, (a, _, _) in enumerate(pairs)] + [(100 + i, a + b, "t", 1) for i, (a, b, _) in enumerate(pairs) if b]
    assert found(spark, rows) == {i for i, (_, _, cut) in enumerate(pairs) if cut}


def test_prefixes_across_partitions(spark):
    texts = [f"{w} (item {i})" for i in range(40) for w in ("Lift", "Turn")]
    texts += [t + " and hold" for t in texts[::2]] + [t + ". Then go" for t in texts[1::2]] + ["Done.", "Done. Next", "Over.", "Over.more"]
    want = {t for t in texts if any(_goes_on(t, x) for x in texts if x.startswith(t) and x != t)}
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # keeps the ranges apart
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        assert prefixes(spark, texts) == want
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert "Over." in want and "Done." not in want


def test_nulls_blanks_repeats_and_lengths(spark):
    rows = [(1, None, None, 1), (2, "", "s", 1), (3, " \n", "s", 1), (4, "word " * 20000 + "end.", None, 1), (5, "9" * 5000, "s", 1), (6, "same text ends.", "s", 1), (6, "same text ends.", "s", 1), (7, "¶", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, key int")
    out = truncated(df).collect()
    assert len(out) == len(rows) and not any(r["cut"] for r in out if r["doc_id"] != 5)
    assert truncated(df.limit(0)).count() == 0
