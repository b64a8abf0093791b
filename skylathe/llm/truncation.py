"""Texts whose end was lost: cut at a field limit or in transfer, in a word or in a sentence.

A text is found by what its end is a strict prefix of. Three searches over the whole corpus, none with a cap:

1. Copies: texts are sorted; one that is a strict prefix of another is one of its successor. It is cut whatever it
   ends with, unless the other one begins a new sentence or line there.
2. Tails: the last word, or the signs behind it, with up to three words before it are hashed. Every place of every
   distinct text whose context is that of some tail yields the hashes of the prefixes of its word and of its signs
   (hash fixed-length prefixes), so an equi-join tells, for each tail, how often the same context is followed by
   something longer that begins so, by just this inside a sentence, and by just this at an end. A cut tail is a
   prefix of longer copies and never an end; the end of a complete text is an end elsewhere too. No sign is known
   beforehand to be open: a comma is because the corpus goes on behind it. Places are sifted by a bitmap of the
   tails' hashes before anything is shuffled. Above the greatest size of a bitmap the hashes are divided and the
   texts are read once for each part; what passes by chance is dropped by the join.
3. Limits: lengths, in characters and in bytes, at which a source's texts pile up. They decide where a tail
   alone does not.

An ellipsis, or a hyphen that parts a word, is taken off the end first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import HEAVY_FLOOR, heavy_keys, skew_join
from ..session import cut

#: Words before the last one that make a tail's context, at most.
CONTEXT = 3
#: A tail needs so many other places to be judged by.
SUPPORT = 2
#: Share of sentence ends among a tail's other places below which it is cut.
END_SHARE = 0.2
#: The same at a length at which the source's texts pile up.
END_SHARE_AT_LIMIT = 0.6
#: A length is a limit if so many texts of a source have it, and so many times the mean of the ten to each side.
LIMIT_TEXTS = 5
LIMIT_TIMES = 4
LIMIT_REACH = 10
#: Bits of a bitmap: 16 to 32 for each hash, between these powers of two (the greatest are 64 MB). More hashes are
#: divided among several bitmaps.
BITS_LEAST, BITS_MOST = 16, 29
#: Most sources with limits, and most texts at the borders of sorted partitions, that are broadcast.
BROADCAST_ROWS, BROADCAST_CHARS = 10_000, 4_000_000
#: Words up to this length are hashed together; longer ones one by one.
WORD_COLUMNS = 24

WORD = re.compile(r"(\d+(?:[.,/:\-]\d+)*|[^\W\d_]+(?:['’\-][^\W\d_]+)*)")
#: A break between entries, items or paragraphs; other line ends only wrap the text.
BREAK = re.compile(r"""\n\s*\n| / |[.!?…|>]["'”’)]*[ \t]*\r?\n|\n\s*(?=[-*|#/—•]|\d+\.|[QA]:|[A-Z#]{2})""")
SENTENCE_END = re.compile(r"""\s*(?:[.!?…]+(?=[\s"'”’)\]<]|$)|\n\s*\n| / )""")
#: A sentence is over: its mark, with closing quotes, brackets and tags.
SENTENCE_OVER = re.compile(r"""[.!?…](?:["'”’»)\]}]|</[^<>]*>)*\Z""")
#: What makes it go on all the same behind white space: a number that is no list item's.
NUMBER_NEXT = re.compile(r"\s+\d+(?![\d.)]*[.)](?:\s|\Z))")
_C = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def _word_hash(w: str) -> int:
    return xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))


def _text_hash(t: str) -> bytes:
    """128 bits, so that no two texts are taken for one."""
    return xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass"))


def _signs(gap: str) -> str:
    """What stands between words, with line ends as \\n, single blanks and at most two of a sign in a row."""
    return re.sub(r"([^\w\s])\1+", r"\1\1", re.sub(r"[ \t]+", " ", re.sub(r"\r\n?", "\n", gap)))


def _sign_hash(signs: str) -> int:
    return _word_hash("\x00" + signs)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _masked(w: str) -> str:
    return "0" if w[0].isdigit() else w.lower()


def _broken(gap: str, ahead: str) -> bool:
    """Whether a line, entry or paragraph ends between two words; ``ahead``: what follows the gap."""
    return ("\n" in gap or " / " in gap) and BREAK.search(gap + ahead[:3]) is not None


def _read(text: str) -> tuple[list[str], list[str], list[bool]]:
    """Words (digits masked, lower case), what stands behind each, and whether there is a break of lines."""
    parts = WORD.split(text)
    words, gaps = parts[1::2], parts[2::2]
    breaks = [_broken(g, w + h) if g != " " else False for g, w, h in zip(gaps, words[1:], gaps[1:])]
    return [_masked(w) for w in words], gaps, breaks + [False] * (len(words) - len(breaks))


def _follow(gap: str, broken: bool, last: bool) -> int:
    """What comes after a word: 1 the end of a sentence or line, 2 more of it, 3 the end of the text, 4 unclear."""
    if last and not gap.strip():
        return 3
    if broken or SENTENCE_END.match(gap if last else gap + "x"):
        return 1
    return 4 if gap.lstrip(" ")[:1] in ("\r", "\n") else 2


def _body(text: str) -> tuple[str, str]:
    """The text without white space and marks of a cut at its end, and the mark."""
    b = text.rstrip()
    if b.endswith("..."):
        return b[:-3].rstrip(), "…"
    if b.endswith("…"):
        return b[:-1].rstrip(), "…"
    if b.endswith("-") and len(b) > 1 and b[-2].isalnum():
        return b[:-1], "-"
    return b, ""


def _tail(body: str) -> tuple[str, list[int], list[int], bool]:
    """Kind of the end (word, signs, none: a whole sentence or no word), hashes of its contexts, of the contexts with it, and whether it is a number."""
    # the words of the last stretch are enough: a context has three of them
    stretch = body[-400:]
    words, gaps, breaks = _read(stretch)
    if len(words) <= CONTEXT + 1 and len(stretch) < len(body):
        words, gaps, breaks = _read(body)
    if not words:
        return "none", [], [], False
    signs = _signs(gaps[-1])
    if words[-1] != "0" and SENTENCE_OVER.search(signs):  # behind a number a point may also mark a list item
        return "none", [], [], False
    run = [x for w, b in zip(words[-CONTEXT - 1 :], breaks[-CONTEXT - 1 :]) for x in ((w, "¶") if b else (w,))]
    hashes = np.array([_word_hash(w) for w in run[-CONTEXT - 1 :]], dtype=np.uint64)
    if signs:
        hashes = np.append(hashes, np.uint64(_sign_hash(signs)))
    contexts, keys = [], []
    for j in range(min(CONTEXT, len(hashes) - 1) + 1):
        c = _context(hashes, j)[-1:]
        contexts.append(int(c.view(np.int64)[0]))
        keys.append(int(_key(c, hashes[-1:]).view(np.int64)[0]))
    return ("signs" if signs else "word"), contexts, keys, not signs and words[-1] == "0"


def _ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for key, source, text in zip(b["key"], b["source"], b["text"]):
            body, mark = _body(text)
            kind, contexts, keys, number = _tail(body) if body else ("none", [], [], False)
            whole = text if kind == "word" and ("\n" in text[len(body) :] or "\r" in text[len(body) :]) else None
            coded = text.encode("utf-8", "surrogatepass")
            h = xxhash.xxh3_128_digest(coded)
            rows.append((key, source, h, kind, mark, len(text), len(coded), number, contexts, keys, h if len(body) == len(text) else _text_hash(body), body, whole))
        yield pd.DataFrame(rows, columns=["key", "source", "h", "kind", "mark", "chars", "bytes", "number", "contexts", "keys", "b", "body", "whole"])


def _key(context: np.ndarray, what: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(context + what)


def _context(hashes: np.ndarray, j: int) -> np.ndarray:
    """Hash of the j words before each place from j on; its length is that of ``hashes`` less j."""
    n = len(hashes) - j
    c = np.full(n, j + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(1, j + 1):
            c = c * np.uint64(_C[0]) + hashes[j - k : j - k + n] * np.uint64(_C[k % 3])
        return _mix(c)


class _Words:
    """Hashes of the prefixes of the words seen by a task, started anew when there are many."""

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}
        self.seen: dict[str, int] = {}
        self.prefixes = np.zeros((1024, WORD_COLUMNS), dtype=np.uint64)
        self.full = np.zeros(1024, dtype=np.uint64)
        self.length = np.zeros(1024, dtype=np.int32)
        self.long: dict[int, list[int]] = {}

    def raw(self, w: str) -> int:
        """Id of a word as written."""
        i = self.seen.get(w)
        if i is None:
            i = self.seen[w] = self.id(_masked(w))
        return i

    def id(self, w: str) -> int:
        i = self.ids.get(w)
        if i is None:
            i = self.ids[w] = len(self.ids)
            if i == len(self.full):
                self.prefixes = np.concatenate([self.prefixes, np.zeros_like(self.prefixes)])
                self.full = np.concatenate([self.full, np.zeros_like(self.full)])
                self.length = np.concatenate([self.length, np.zeros_like(self.length)])
            self.full[i], self.length[i] = _word_hash(w), len(w)
            if w != "0" and w != "¶":
                self.prefixes[i, : min(len(w) - 1, WORD_COLUMNS)] = [_word_hash(w[:n]) for n in range(1, min(len(w) - 1, WORD_COLUMNS) + 1)]
                if len(w) - 1 > WORD_COLUMNS:
                    self.long[i] = [_word_hash(w[:n]) for n in range(WORD_COLUMNS + 1, len(w))]
            else:
                self.length[i] = 1
        return i


class _Gaps:
    """What stands between two words: what follows the first, and (hash, kind) of the signs and their prefixes."""

    def __init__(self) -> None:
        self.known: dict[tuple[str, bool, bool, bool], tuple[int, list[tuple[int, int]]]] = {}

    def of(self, gap: str, broken: bool, capital: bool, last: bool) -> tuple[int, list[tuple[int, int]]]:
        key = (gap, broken, capital, last)
        have = self.known.get(key)
        if have is None:
            if len(self.known) > 100_000:
                self.known.clear()
            have = self.known[key] = _follow(gap, broken, last), self._signs(*key)
        return have

    @staticmethod
    def _signs(gap: str, broken: bool, capital: bool, last: bool) -> list[tuple[int, int]]:
        signs = _signs(gap)
        full = signs.rstrip()
        if not full:
            return []
        if last:
            return [(_sign_hash(full), 3)]
        breaks = [n for n in (signs.find("\n"), signs.find(" / ")) if n >= 0]
        line = signs[: min(breaks)].rstrip() if breaks else ""  # what ends the line or entry
        out = []
        for n in range(1, len(full)):
            part = full[:n]
            if part[-1].isspace():
                continue
            if part == line:
                out.append((_sign_hash(part), 1 if broken else 4))
            else:
                out.append((_sign_hash(part), 0))
        over = SENTENCE_OVER.search(full) and signs[-1].isspace() and capital
        out.append((_sign_hash(full), (1 if broken else 4) if full == line else 1 if over else 2))
        return out


def _places(bitmap, part: int, parts: int):
    """For distinct bodies, the tails' keys found at their places: longer, end, inside, at a text's end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.frombuffer(bitmap.value, dtype=np.uint64)
        top = np.uint64(len(bits) * 64 - 1)

        def held(h: np.ndarray, own: bool = False) -> np.ndarray:
            """Whether hashes may be a tail's; ``own``: contexts, which decide the part of the hashes below them."""
            at = h & top
            hit = (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
            return hit & ((h >> np.uint64(33)) % np.uint64(parts) == np.uint64(part)) if own and parts > 1 else hit

        words, gaps = _Words(), _Gaps()
        for b in batches:
            for texts in _slices(b["body"]):
                if len(words.seen) > 300_000:
                    words = _Words()
                yield _stats(texts, words, gaps, held)

    return run


def _slices(texts: pd.Series, chars: int = 2_000_000) -> Iterator[list[str]]:
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t)
        if n >= chars:
            yield part
            part, n = [], 0
    if part:
        yield part


def _stats(bodies: list[str], words: _Words, gaps: _Gaps, held) -> pd.DataFrame:
    ids, first, follows = [], [], []
    at_word, at_hash, at_kind = [], [], []  # signs: the place of the word before them, their hash, what follows
    para = words.id("¶")
    for body in bodies:
        parts = WORD.split(body)
        raws, base = parts[1::2], len(ids)
        left = len(raws)
        for k, gap in enumerate(parts[2::2]):
            left -= 1
            ids.append(words.raw(raws[k]))
            if gap == " " and left:
                follows.append(2)
                continue
            ahead = raws[k + 1] if left else ""
            broken = bool(left) and _broken(gap, ahead + parts[2 * k + 4])
            follow, signs = gaps.of(gap, broken, bool(left) and not ahead[0].islower(), not left)
            for h, kind in signs:
                at_word.append(len(ids) - 1)
                at_hash.append(h)
                at_kind.append(kind)
            follows.append(follow)
            if broken:
                ids.append(para)
                follows.append(4)
        first.extend(range(len(ids) - base))
    keys, kinds, times = [], [], []

    def give(key: np.ndarray, kind: np.ndarray | int, n: np.ndarray | None = None) -> None:
        hit = held(key)
        key = key[hit]
        keys.append(key)
        kinds.append(np.full(len(key), kind, dtype=np.int8) if isinstance(kind, int) else kind[hit])
        times.append(np.ones(len(key), dtype=np.int64) if n is None else n[hit])

    if ids:
        wid, place = np.array(ids), np.array(first)
        full = words.full[wid]
        follow = np.array(follows, dtype=np.int8)
        sign_at, sign_hash, sign_kind = np.array(at_word, dtype=np.int64), np.array(at_hash, dtype=np.uint64), np.array(at_kind, dtype=np.int8)
        behind = np.append(full, np.uint64(0))
        for j in range(CONTEXT + 1):
            if len(wid) >= j and len(sign_at):  # signs stand for a word behind the one before them
                mine = np.nonzero(place[sign_at] + 1 >= j)[0]
                ctx = _context(behind, j)[sign_at[mine] + 1 - j]
                ok = held(ctx, own=True)
                give(_key(ctx[ok], sign_hash[mine][ok]), sign_kind[mine][ok])
            if len(wid) <= j:
                break
            ctx = _context(full, j)
            at = np.nonzero((place[j:] >= j) & held(ctx, own=True))[0]
            ctx, w, pos = ctx[at], wid[at + j], at + j
            # the word itself
            give(_key(ctx, words.full[w]), follow[pos])
            # longer words that begin with a tail's word; the same word in the same context is looked up once
            order = np.lexsort((w, ctx))
            ctx, w = ctx[order], w[order]
            start = np.nonzero(np.append(True, (ctx[1:] != ctx[:-1]) | (w[1:] != w[:-1])))[0] if len(w) else np.zeros(0, dtype=np.int64)
            ctx, w, n = ctx[start], w[start], np.diff(np.append(start, len(w)))
            for k in range(WORD_COLUMNS):
                more = words.length[w] > k + 1
                if not more.any():
                    break
                ctx, w, n = ctx[more], w[more], n[more]
                give(_key(ctx, words.prefixes[w, k]), 0, n)
            for c, i, m in zip(ctx, w, n) if words.long else ():
                more = words.long.get(int(i))
                if more:
                    give(_key(np.full(len(more), c, dtype=np.uint64), np.array(more, dtype=np.uint64)), 0, np.full(len(more), m))
    key = np.concatenate(keys) if keys else np.zeros(0, dtype=np.uint64)
    kind = np.concatenate(kinds) if kinds else np.zeros(0, dtype=np.int8)
    n = np.concatenate(times) if times else np.zeros(0, dtype=np.int64)
    uniq, back = np.unique(key, return_inverse=True)
    out = {"k": uniq.view(np.int64)}
    for name, code in (("longer", 0), ("ends", 1), ("inside", 2), ("last", 3)):
        out[name] = np.bincount(back[kind == code], weights=n[kind == code], minlength=len(uniq)).astype(np.int64)
    return pd.DataFrame(out)


def _bitmap(hashes: DataFrame, n: int) -> bytes:
    """Bits of a column of hashes ``h``; at most 2^BITS_MOST of them reach the driver."""
    power = min(BITS_MOST, max(BITS_LEAST, (16 * max(1, n)).bit_length()))
    at = F.col("h").bitwiseAND((1 << power) - 1)
    words = hashes.select(F.shiftright(at, 6).cast("int").alias("i"), F.expr("shiftleft(1L, cast(h & 63 AS int))").alias("b")).groupBy("i").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (power - 6), dtype=np.int64)
    out[words["i"].to_numpy()] = words["b"].to_numpy()
    return out.tobytes()


def tail_statistics(bodies: DataFrame, tails: DataFrame) -> DataFrame:
    """(k, longer, ends, inside, last): how often each tail's key is found at the places of all ``bodies`` (body).

    ``tails`` has the arrays contexts and keys. Bitmaps hold their distinct hashes; a context's hash decides in
    which one it and the keys below it are, so a part of them is asked for in each reading of the texts.
    """
    pairs = cut(tails.select(F.explode(F.arrays_zip("contexts", "keys")).alias("t")).select(F.col("t.contexts").alias("c"), F.col("t.keys").alias("k")).distinct())
    n = 2 * pairs.count()
    parts = -(-16 * n // (1 << BITS_MOST)) if n else 1
    out = None
    for part in range(parts):
        own = pairs.filter(F.pmod(F.shiftrightunsigned("c", 33), F.lit(parts)) == part) if parts > 1 else pairs
        hashes = own.select(F.explode(F.array("c", "k")).alias("h"))
        shipped = bodies.sparkSession.sparkContext.broadcast(_bitmap(hashes, -(-n // parts)))
        found = bodies.select("body").mapInPandas(_places(shipped, part, parts), "k bigint, longer bigint, ends bigint, inside bigint, last bigint")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("k").agg(*[F.sum(c).alias(c) for c in ("longer", "ends", "inside", "last")])


def _goes_on(text: str, longer: str) -> bool:
    """Whether a longer text goes on in the same line, with more than punctuation and not with a new sentence.

    A new sentence follows a sentence's mark and white space, and does not begin with a number; a small letter does
    not tell, as what follows a whole sentence may begin with one.
    Behind a letter or digit, or a line end that the text itself still has, all that follows goes on.
    """
    rest = longer[len(text) :]
    if rest[:1] in "\r\n" or not any(map(str.isalnum, rest)):
        return False
    if text[-1].isalnum() or text[-1].isspace():
        return True
    if rest.lstrip(" \t")[0] in "\r\n":
        return False
    return not rest[0].isspace() or not SENTENCE_OVER.search(text[-200:]) or bool(NUMBER_NEXT.match(rest))


def _neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of a sorted partition of distinct texts: hashes of those that go on in a longer one ('prefix'), the first
    text, and those that texts of the next partitions may yet go on ('last')."""
    open_: list[tuple[bytes, str]] = []  # each a prefix of the next one; of these none was found to go on
    started, part = False, None
    for b in batches:
        rows = []
        for pid, h, text in zip(b["pid"], b["h"], b["text"]):
            if not started:
                rows.append((pid, "first", h, text))
                started, part = True, pid
            while open_ and not text.startswith(open_[-1][1]):
                open_.pop()
            rows.extend((pid, "prefix", k, None) for k, t in open_ if _goes_on(t, text))
            open_ = [(k, t) for k, t in open_ if not _goes_on(t, text)]
            open_.append((h, text))
        yield pd.DataFrame(rows, columns=["pid", "what", "h", "text"])
    if open_:
        yield pd.DataFrame([(part, "last", h, t) for h, t in open_], columns=["pid", "what", "h", "text"])


def _goes_on_later(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"h": [h for h, text, longer in zip(b["h"], b["text"], b["longer"]) if _goes_on(text, longer)]}, dtype="object")


def strict_prefixes(texts: DataFrame) -> DataFrame:
    """(h) of the texts that another one goes on (``_goes_on``).

    ``texts`` has h, a binary hash of the text, and text. In sorted order the texts that start with a given one
    follow it, so a stack of open prefixes finds all within a partition. What is still open at a partition's end, and
    the next partition's first text starts with, is compared with all texts that begin like it, found by the hash of
    a prefix of fixed length (the largest power of two that is no longer than the open text).
    """
    distinct = cut(texts.groupBy("h").agg(F.first("text").alias("text")))
    ranged = distinct.repartitionByRange("text").sortWithinPartitions("text").select(F.spark_partition_id().alias("pid"), "h", "text")
    seen = cut(ranged.mapInPandas(_neighbours, "pid int, what string, h binary, text string"))
    # few rows a partition; "first" sorts before "last"
    following = F.min(F.when(F.col("what") == "first", F.struct("pid", "text"))).over(Window.orderBy("pid").rangeBetween(1, Window.unboundedFollowing))
    border = seen.filter("what <> 'prefix'").withColumn("next", following["text"]).filter("what = 'last' and startswith(next, text)")
    size = F.expr("cast(shiftleft(1, cast(floor(log2(length(text))) as int)) as int)")
    border = cut(border.select("h", "text", size.alias("n")).withColumn("p", F.xxhash64(F.expr("left(text, n)"))))
    n, chars = border.agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
    found = seen.filter("what = 'prefix'").select("h")
    if not n:
        return found.distinct()
    sizes = [r[0] for r in border.select("n").distinct().collect()]  # powers of two: as many as a length has bits
    starts = F.explode(F.array_compact(F.array(*[F.when(F.length("text") > k, F.struct(F.lit(k).alias("n"), F.xxhash64(F.left("text", F.lit(k))).alias("p"))) for k in sizes])))
    longer = distinct.select(F.col("text").alias("longer"), starts.alias("s")).select("longer", "s.n", "s.p")
    small = n <= BROADCAST_ROWS and chars <= BROADCAST_CHARS
    later = longer.join(F.broadcast(border) if small else border, ["n", "p"]).filter("startswith(longer, text) and longer <> text")
    return found.unionByName(later.select("h", "text", "longer").mapInPandas(_goes_on_later, "h binary")).distinct()


def limits(ends: DataFrame) -> DataFrame:
    """(source, unit, length) at which a source's texts pile up."""
    lengths = ends.select("source", "h", F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).alias("length")) for u in ("chars", "bytes")])).alias("u")).select("source", "h", "u.*")
    counts = lengths.groupBy("source", "unit", "length").agg(F.count_distinct("h").alias("n"))  # copies of one text are no pile
    near = Window.partitionBy("source", "unit").orderBy("length").rangeBetween(-LIMIT_REACH, LIMIT_REACH)
    around = (F.sum("n").over(near) - F.col("n")) / (2 * LIMIT_REACH)
    return counts.withColumn("around", around).filter((F.col("n") >= LIMIT_TEXTS) & (F.col("n") >= LIMIT_TIMES * F.greatest("around", F.lit(0.5)))).select("source", "unit", "length")


def _verdict() -> Column:
    """Whether an end that no other text goes on is cut, by what its tail is elsewhere."""
    share = F.when(F.col("limit"), END_SHARE_AT_LIMIT).otherwise(END_SHARE)
    # a number at a limit that ends entries inside texts may lack digits; one that ends texts is a closing line
    word = F.when(F.col("share").isNull(), F.col("limit")).otherwise(F.col("share") < share) | (F.col("limit") & F.col("number") & F.col("inner"))
    # signs end words of their own; what no place tells is complete
    signs = F.coalesce(F.col("share") < END_SHARE, F.lit(False))
    return F.when(F.col("kind") == "word", word).when(F.col("kind") == "signs", signs).otherwise(False)


def truncated(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", floor: int = HEAVY_FLOOR) -> DataFrame:
    """(key, source, cut): whether each text lacks its end.

    Null, empty and white texts are complete. A text that another one goes on is not, unless a new sentence or line
    begins there. Of the others, those are complete whose last words, or the signs behind them, end sentences or
    lines elsewhere, and those whose tail the corpus has no other place for, unless a word lies at a limit.
    Rows under one key are judged together. Sources may be null. Whole texts are read.
    """
    rows = df.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("text"))
    full = rows.filter(F.col("text").isNotNull() & F.col("text").rlike(r"\S"))
    kind = dict(df.dtypes)[key]
    ends = cut(full.mapInPandas(_ends, f"key {kind}, source string, h binary, kind string, mark string, chars int, bytes int, number boolean, contexts array<bigint>, keys array<bigint>, b binary, body string, whole string"))
    # copies of a text, also with other white space or marks at the end, are one: they are no evidence for each other
    bodies = cut(ends.filter("body <> ''").groupBy("b").agg(F.first("body").alias("body")))
    tails = ends.filter("kind <> 'none'")
    stats = tail_statistics(bodies, tails)
    asked = tails.select("key", F.posexplode("keys").alias("j", "k"))
    hot = heavy_keys(asked.groupBy("k").agg(F.count(F.lit(1)).alias("n")), ["k"], "n", floor=floor)
    judged = skew_join(asked, stats, ["k"], hot, "inner")
    own = F.greatest(F.col("last") - 1, F.lit(0))  # a text is no evidence for itself
    judged = judged.select("key", "j", "ends", own.alias("own"), (F.col("ends") + own).alias("e"), (F.col("longer") + F.col("inside") + F.col("ends") + own).alias("all")).filter(F.col("all") >= SUPPORT)
    best = judged.groupBy("key").agg(F.max_by(F.struct("j", (F.col("e") / F.col("all")).alias("share"), (F.col("ends") > F.col("own")).alias("inner")), "j").alias("b")).select("key", "b.*")

    near = cut(limits(ends))
    at = near.groupBy(F.concat(F.lit("="), "source").alias("s")).agg(*[F.collect_set(F.when(F.col("unit") == u, F.col("length"))).alias(f"at_{u}") for u in ("chars", "bytes")])  # a source has few limits
    sourced = ends.withColumn("s", F.concat(F.lit("="), "source"))
    large = heavy_keys(sourced.groupBy("s").agg(F.count(F.lit(1)).alias("n")), ["s"], "n", floor=floor)
    placed = skew_join(sourced, at.filter("s is not null"), ["s"], large, "left")
    if near.filter("source is null").limit(1).count():  # texts without a source are one of their own
        of_none = F.broadcast(near.filter("source is null").agg(*[F.collect_set(F.when(F.col("unit") == u, F.col("length"))).alias(f"none_{u}") for u in ("chars", "bytes")]))
        placed = placed.join(of_none, F.col("s").isNull(), "left").withColumns({f"at_{u}": F.coalesce(f"at_{u}", f"none_{u}") for u in ("chars", "bytes")})
    in_bytes = F.arrays_overlap("at_bytes", F.sequence(F.col("bytes"), F.col("bytes") + 3))  # a character of several bytes may have been dropped
    limit = F.coalesce(F.array_contains("at_chars", F.col("chars")), F.lit(False)) | F.coalesce(in_bytes, F.lit(False))

    # that another text goes on decides, whatever the end looks like; one cut behind a line end is looked up with it too
    forms = bodies.select(F.col("b").alias("h"), F.col("body").alias("text")).unionByName(ends.filter("whole is not null").select("h", F.col("whole").alias("text")))
    prefix = cut(strict_prefixes(forms))
    hit = lambda c: prefix.select(F.col("h").alias(c), F.lit(True).alias(f"prefix_{c}"))
    longer = F.coalesce("prefix_b", "prefix_h", F.lit(False))
    all_ = placed.withColumn("limit", limit).join(best, "key", "left").join(hit("b"), "b", "left").join(hit("h"), "h", "left")
    out = all_.select("key", (longer | _verdict()).alias("cut")).groupBy("key").agg(F.bool_or("cut").alias("cut"))
    return rows.select("key", "source").join(out, "key", "left").select(F.col("key").alias(key), "source", F.coalesce("cut", F.lit(False)).alias("cut"))
