"""Text decoded with a wrong character encoding: find the records and restore them, by noisy-channel decoding.

Only runs matter: stretches of ASCII letters and non-ASCII characters that hold a non-ASCII character. The corpus gives
each run its number of distinct texts, so copies of a text count once; runs of at least a share ``COMMON`` of them are
the word model, their character pairs the pair model, both of bounded size at any number of documents. If a misreading
turns several common words into other words less common than they are, a source is damaged throughout: its runs are left out of both models
and don't speak for themselves (as long as such texts are fewer than sound ones with the same words). Each other distinct run is decoded
once: a lattice over its characters has arcs for bytes of a multi-byte character read one by one under any of the
``READ_AS`` encodings, for wildcards where bytes were lost (U+FFFD), and whole-run arcs for one single-byte encoding
read as another; a beam Viterbi search takes the best path under the pair model, word frequencies decide.

Defined results: null, empty and pure ASCII texts are never found; U+FFFD and C1 control characters are always damage,
restorable or not; a run is damaged too if its decoding is far commoner than itself. Runs of one or two letters aren't judged
against another single-byte encoding, as any letter is some other letter there. Repeated texts are judged alike;
runs beyond ``PIECE`` characters are cut where no byte sequence can span, none dropped, and stay whole where one can; a
restoration of lost bytes that is no word of the corpus doesn't count; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft import runtime
from graphweft.llm import text_units as tu

READ_AS = ("cp1252", "cp437", "cp850", "mac_roman", "cp1250", "cp1251", "koi8_r", "cp866", "iso8859_5", "iso8859_2", "mac_cyrillic", "cp852", "cp1253", "cp1254", "iso8859_15", "cp1257")
WRITTEN_AS = ("cp1252", "cp1251", "koi8_r", "cp866", "mac_roman", "cp437", "cp850", "iso8859_5", "cp1250", "mac_cyrillic")
#: Least share of documents of a run of the word model and of a common pair; how much commoner a decoding must be than the run.
COMMON, FAIR, FAR = 1 / 5000, 1 / 1000, 20.0
PIECE, CHARS, BEAM = 64, 4_000_000, 12
#: So many common words misread in one way show a source that is damaged throughout.
WITNESSES = 3
LOST = "�"


@functools.cache
def _codec(name: str) -> tuple[dict[str, int], list[str]]:
    """Character to byte and byte to character; bytes without a character are C1 controls, as lenient decoders read them."""
    table = []
    for b in range(256):
        try:
            table.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            table.append(chr(b))
    back = {chr(b): b for b in range(128, 160)} if name.startswith("cp125") else {}
    back.update({c: b for b, c in enumerate(table) if b > 127})
    return back, table


@functools.cache
def _single(read: str, written: str) -> dict[int, int]:
    """str.translate table that undoes reading ``written`` as ``read``; characters that ``read`` lacks are absent."""
    back, table = _codec(read)[0], _codec(written)[1]
    return {ord(c): ord(table[b]) for c, b in back.items()}


@functools.cache
def _bytelike() -> np.ndarray:
    """By code point: whether some encoding reads a byte above 127 as this character."""
    out = np.zeros(0x110000, bool)
    for name in READ_AS:
        out[[ord(c) for c in _codec(name)[0]]] = True
    out[[*range(128, 160), ord(LOST)]] = True
    return out


def _cut(codes: np.ndarray, a: int, b: int) -> list[tuple[int, int]]:
    """Pieces of a long run: ends beside a character that can't be a byte of a sequence, PIECE apart where there are any."""
    part = _bytelike()[codes[a:b]]
    safe = np.append(np.flatnonzero(~part[1:] | ~part[:-1]) + 1 + a, b)
    out = []
    while b - a > PIECE:
        k = np.searchsorted(safe, a + PIECE, "right")
        end = int(safe[k - 1]) if k and safe[k - 1] > a else int(safe[k])
        out.append((a, end))
        a = end
    return out + [(a, b)] * (b > a)


def runs(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """All runs of the texts and the number of the text of each."""
    joined, codes, ends = tu.join(texts)
    odd = codes > 127
    lower = codes | 32
    inside = odd | ((lower >= 97) & (lower <= 122))
    inside[ends] = False
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False]))))
    a, b = edge[::2], edge[1::2]
    upto = np.concatenate(([0], np.cumsum(odd)))
    keep = upto[b] > upto[a]
    a, b = a[keep], b[keep]
    if len(a) and (b - a).max() > PIECE:
        cut = [x for i, j in zip(a.tolist(), b.tolist()) for x in ([(i, j)] if j - i <= PIECE else _cut(codes, i, j))]
        a, b = np.array(cut).T
    return [joined[i:j] for i, j in zip(a.tolist(), b.tolist())], np.searchsorted(ends, a)


def _texts(batch: pa.RecordBatch, i: int) -> Iterator[tuple[int, list[str]]]:
    texts = [t or "" for t in batch.column(i).to_pylist()]
    for a, b in tu.slices(np.fromiter(map(len, texts), np.int64, len(texts)), CHARS):
        yield a, texts[a:b]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        got = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["run", "n"])
        seen.clear()
        return got

    for batch in batches:
        for _, texts in _texts(batch, 0):
            words, at = runs(texts)
            seen[""] += len(texts)
            seen.update(w for w, _ in set(zip(words, at.tolist())))
            if len(seen) > 500_000:
                yield out()
    if seen:
        yield out()


class Decoder:
    """Word and pair model, and the search."""

    def __init__(self, total: int, words: dict[str, int], pairs: dict[str, int], spoiled: frozenset[str] = frozenset()):
        self.total, self.words, self.spoiled = total, words, spoiled
        self.least = max(2.0, COMMON * total)
        single: Counter[str] = Counter()
        for p, n in pairs.items():
            single[p[0]] += n
        thin = max(10.0, 0.02 * total)  # a character of few documents predicts little
        self.pair = {p: math.log(n / (single[p[0]] + thin)) for p, n in pairs.items()}
        self.often = {p for p, n in pairs.items() if n >= max(2.0, FAIR * total)}
        self.known = {c for c, n in single.items() if n >= max(2.0, 5 * FAIR * total)} - {"\n"}
        self.after: dict[str, list[str]] = defaultdict(list)
        for p in sorted(pairs, key=lambda p: -pairs[p]):
            if pairs[p] >= self.least and ord(p[1]) > 127 and p[1] != LOST:
                self.after[p[0]].append(p[1])
        self.none = math.log(0.2 / max(total, 2)) - 4

    def cost(self, w: str) -> float:
        p, get = "\n", self.pair.get
        total = 0.0
        for c in w + "\n":
            total += get(p + c, self.none)
            p = c
        return total

    def plain(self, w: str) -> bool:
        """Each of its character pairs is common in the corpus."""
        p = "\n"
        for c in w + "\n":
            if p + c not in self.often:
                return False
            p = c
        return True

    @staticmethod
    def _peel(w: str, name: str) -> str:
        """All multi-byte characters that were read one by one as ``name`` put back."""
        back, out, i = _codec(name)[0], [], 0
        code = [back.get(c, 0) for c in w]
        while i < len(w):
            b = code[i]
            n = 2 if 0xC2 <= b <= 0xDF else 3 if 0xE0 <= b <= 0xEF else 4 if 0xF0 <= b <= 0xF4 else 0
            c = w[i]
            if n and i + n <= len(w) and all(0x80 <= x <= 0xBF for x in code[i + 1 : i + n]):
                try:
                    c = bytes(code[i : i + n]).decode()
                except UnicodeDecodeError:
                    n = 0
            else:
                n = 0
            out.append(c)
            i += n or 1
        return "".join(out)

    def _arcs(self, w: str) -> dict[int, list[tuple[int, str]]]:
        """From each position: where a multi-byte character read one by one may end, and the character."""
        arcs: dict[int, list[tuple[int, str]]] = defaultdict(list)
        for name in READ_AS:
            back = _codec(name)[0]
            code = [back.get(c, 0) for c in w]
            for i, b in enumerate(code):
                n = 2 if 0xC2 <= b <= 0xDF else 3 if 0xE0 <= b <= 0xEF else 4 if 0xF0 <= b <= 0xF4 else 0
                if n and i + n <= len(code) and all(0x80 <= x <= 0xBF for x in code[i + 1 : i + n]):
                    try:
                        c = bytes(code[i : i + n]).decode()
                    except UnicodeDecodeError:
                        continue
                    if (i + n, c) not in arcs[i]:
                        arcs[i].append((i + n, c))
        return arcs

    def search(self, w: str) -> tuple[str, int]:
        """Best path through the lattice and the number of its arcs that aren't identities."""
        arcs = self._arcs(w)
        if not arcs and LOST not in w:
            return w, 0
        if len(w) > PIECE:
            return self._search_long(w, arcs)
        get = self.pair.get
        beams: list[dict[str, tuple[float, int]]] = [{} for _ in range(len(w) + 1)]
        beams[0] = {"": (0.0, 0)}
        for i, c in enumerate(w):
            kept = sorted(beams[i].items(), key=lambda x: -x[1][0])[:BEAM]
            lost = next((k for k in range(i, len(w)) if w[k] != LOST), len(w)) - i
            for path, (score, used) in kept:
                last = path[-1] if path else "\n"
                steps = [(i + 1, c, 0)] + [(j, x, 1) for j, x in arcs.get(i, ())]
                for k in range(1, min(lost, 3) + 1):
                    steps += [(i + k, x, 1) for x in self.after.get(last, [])[:24]]
                for j, x, new in steps:
                    s = score + get(last + x, self.none) + 1.0 * new
                    if path + x not in beams[j] or beams[j][path + x][0] < s:
                        beams[j][path + x] = (s, used + new)
        ends = [(score + get(path[-1:] + "\n", self.none) + math.log1p(self.words.get(path, 0)), path, used) for path, (score, used) in beams[len(w)].items()]
        _, path, used = max(ends)
        return path, used

    def _search_long(self, w: str, arcs: dict[int, list[tuple[int, str]]]) -> tuple[str, int]:
        """The same for a run that can be no word: one state a position and last character, paths by back-pointers."""
        get = self.pair.get
        states: list[dict[str, tuple[float, int, int, str]]] = [{} for _ in range(len(w) + 1)]
        states[0] = {"\n": (0.0, 0, -1, "")}
        for i, c in enumerate(w):
            lost = i < len(w) and c == LOST
            for last, (score, used, _, _) in sorted(states[i].items(), key=lambda x: -x[1][0])[:BEAM]:
                for j, x, new in [(i + 1, c, 0)] + [(j, x, 1) for j, x in arcs.get(i, ())] + [(i + 1, x, 1) for x in (self.after.get(last, [])[:24] if lost else ())]:
                    s = score + get(last + x, self.none) + 1.0 * new
                    if x not in states[j] or states[j][x][0] < s:
                        states[j][x] = (s, used + new, i, last)
        c = max(states[-1], key=lambda x: states[-1][x][0] + get(x + "\n", self.none))
        used, at, path = states[-1][c][1], len(w), []
        while at > 0:
            path.append(c)
            _, _, at, c = states[at][c]
        return "".join(reversed(path)), used

    def decode(self, w: str, n: int) -> tuple[bool, str | None]:
        """Whether the run is damaged, and its restoration if there is one."""
        if w in self.spoiled:
            n = 0  # its number only tells how large the damaged source is
        sure = any(c == LOST or "\x80" <= c <= "\x9f" for c in w)
        best, arcs = self.search(w)
        top, layer, seen = self.cost(best) + math.log1p(self.words.get(best, 0)), {w}, {w}
        for depth in range(1, 4):  # text that was damaged more than once
            layer = {self._peel(x, name) for x in layer for name in READ_AS} - seen
            seen |= layer
            for x in sorted(layer):
                got, used = self.search(x)
                score = self.cost(got) + math.log1p(self.words.get(got, 0))
                if score > top:
                    best, arcs, top = got, used + depth, score
        if best != w and arcs and all(c in self.known or c.isascii() for c in best) and (sure or self.words.get(best, 0) >= FAR * n or self.cost(best) > self.cost(w) + 3):
            return True, best if LOST not in best and (LOST not in w or best in self.words) else None
        symbol = any(ord(c) > 127 and not c.isalpha() for c in w)
        if sure or symbol or len(w) >= 3:
            odd = [c for c in w if ord(c) > 127]
            top, found = 0, None
            for read in READ_AS:
                back = _codec(read)[0]
                if not all(c in back for c in odd):
                    continue
                for written in WRITTEN_AS:
                    if written == read:
                        continue
                    r = w.translate(_single(read, written))
                    if r == w or not all(c in self.known or c.isascii() for c in r):
                        continue
                    f = self.words.get(r, 0)
                    if f >= max(self.least, FAR * n) and f > top:
                        top, found = f, r
                    elif not top and found is None and len(odd) >= 3 and self.plain(r) and self.cost(r) > self.cost(w) + 6 * len(odd) / 2:
                        found = r
            if found:
                return True, found
        return sure, None


def _undone(w: str, kinds: set | None = None) -> Iterator[tuple[tuple[str, str], str]]:
    """Misreadings (read, written) and the run with each of them undone; only those of ``kinds`` if given."""
    odd = [c for c in w if ord(c) > 127]
    for read in READ_AS:
        if kinds is None or (read, "utf-8") in kinds:
            x = w
            for _ in range(3):  # text that was damaged more than once
                r = Decoder._peel(x, read)
                if r == x:
                    break
                yield (read, "utf-8"), r
                x = r
        back = _codec(read)[0]
        if all(c in back for c in odd):
            for written in WRITTEN_AS:
                if written != read and (kinds is None or (read, written) in kinds):
                    r = w.translate(_single(read, written))
                    if r != w:
                        yield (read, written), r


def _telling(w: str, r: str) -> bool:
    """The undone run is a word and not the run in other letters of case."""
    return len(r) >= 4 and r.isalpha() and r.casefold() != w.casefold()


def _witnesses(batches: Iterator[pa.RecordBatch], words) -> Iterator[pa.RecordBatch]:
    """(run, read, written): common runs that a misreading makes of commoner words."""
    f = words.value
    for batch in batches:
        rows = {(w, *kind) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for kind, r in _undone(w) if f.get(r, 0) > n and _telling(w, r)}
        cols = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["run", "read", "written"])


def _sound(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """The runs that stay in the models: those the misreadings of damaged sources didn't make of likelier words."""
    total, words, pairs, spoiled, kinds = model.value
    single: Counter[str] = Counter()
    for p, n in pairs.items():
        single[p[0]] += n

    def weight(w: str) -> float:
        w = f"\n{w}\n"
        return sum(math.log(pairs.get(w[i : i + 2], 0.5)) for i in range(len(w) - 1))

    def damaged(w: str, n: int) -> bool:
        for (_, written), r in _undone(w, kinds):
            if _telling(w, r) and (words.get(r, 0) > n or (all(c.isascii() or single[c] >= 5 * FAIR * total for c in r) if written == "utf-8" else weight(r) > weight(w) + 1)):
                return True
        return w in spoiled

    for batch in batches:
        keep = [not damaged(w, n) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        yield batch.filter(pa.array(keep, pa.bool_()))


def _pairs(vocabulary: DataFrame, total: int) -> dict[str, int]:
    edged = F.concat(F.lit("\n"), "run", F.lit("\n"))
    pairs = vocabulary.select(F.explode(F.transform(F.sequence(F.lit(1), F.length(edged) - 1), lambda i: edged.substr(i, F.lit(2)))).alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("n"))
    return {r.pair: r.n for r in pairs.filter(F.col("n") >= max(1.0, COMMON * total / 20)).collect()}


def _decode(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    decoder = Decoder(*model.value)
    for batch in batches:
        rows = []
        for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            bad, r = decoder.decode(w, n)
            if bad:
                rows.append((w, n, r))
        cols = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string()))], names=["run", "n", "restored"])


def _rare(batches: Iterator[pa.RecordBatch], usual) -> Iterator[pa.RecordBatch]:
    usual = usual.value
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for a, texts in _texts(batch, 1):
            words, at = runs(texts)
            rows = {(ids[a + i], w) for w, i in zip(words, at.tolist()) if w not in usual}
            cols = list(zip(*rows)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string())], names=["doc_id", "run"])


def damaged_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, run, restored) of damaged runs, and the table of distinct damaged runs (run, n, restored)."""
    spark = docs.sparkSession
    runtime.ship(spark)
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # Copies of a text say nothing more about the language.
    vocabulary = runtime.materialize(picked.select("text").distinct().mapInArrow(_count, "run string, n long").groupBy("run").agg(F.sum("n").alias("n")), "runs")
    total = vocabulary.filter("run = ''").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    vocabulary = vocabulary.filter("run <> ''")
    least = max(2.0, COMMON * total)
    # At most runs-per-document / COMMON rows, at any number of documents.
    common = {r.run: r.n for r in vocabulary.filter(F.col("n") >= least).collect()}
    words, pairs = common, _pairs(vocabulary, total)
    spread = vocabulary.repartition(max(spark.sparkContext.defaultParallelism, vocabulary.rdd.getNumPartitions()), "run")  # a small table, much work a row
    known = spark.sparkContext.broadcast(words)
    seen = defaultdict(set)
    for r in spread.filter(F.col("n") >= least).mapInArrow(lambda b: _witnesses(b, known), "run string, read string, written string").collect():  # common runs only
        seen[r.read, r.written].add(r.run)
    kinds = {kind for kind, own in seen.items() if len(own) >= WITNESSES}
    spoiled = frozenset(w for kind in kinds for w in seen[kind])
    if spoiled:
        first = spark.sparkContext.broadcast((total, words, pairs, spoiled, kinds))
        sound = runtime.materialize(spread.mapInArrow(lambda b: _sound(b, first), "run string, n long"), "sound")
        words, pairs = {r.run: r.n for r in sound.filter(F.col("n") >= least).collect()}, _pairs(sound, total)
    model = spark.sparkContext.broadcast((total, words, pairs, spoiled))
    damaged = runtime.materialize(spread.mapInArrow(lambda b: _decode(b, model), "run string, n long, restored string"), "damaged")
    wrong = {r.run for r in damaged.filter(F.col("n") >= least).select("run").collect()}
    usual = spark.sparkContext.broadcast(frozenset(w for w in common if w not in wrong))
    rare = picked.mapInArrow(lambda b: _rare(b, usual), "doc_id long, run string")
    return rare.join(damaged.select("run", "restored"), "run"), damaged


def found(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id): documents some of whose text was decoded with a wrong encoding."""
    return damaged_runs(docs, doc_id, text)[0].select("doc_id").distinct()


def _mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, fixes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            fix = {f["run"]: f["restored"] for f in fixes if f["restored"] is not None}
            words, _ = runs([text])
            parts, at = [], 0
            for w in words:
                i = text.index(w, at)
                parts += [text[at:i], fix.get(w, w)]
                at = i + len(w)
            out.append("".join(parts) + text[at:])
        lost = [sum(f["restored"] is None for f in fixes) for fixes in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array([len(f) for f in batch.column(2).to_pylist()], pa.int64()), pa.array(lost, pa.int64())], names=["doc_id", "restored_text", "n_damaged", "n_lost"])


def restore(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, restored_text, n_damaged, n_lost): the found documents with their damaged runs replaced where that is possible."""
    hits = damaged_runs(docs, doc_id, text)[0].groupBy("doc_id").agg(F.collect_set(F.struct("run", "restored")).alias("fixes"))  # a document's own runs
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return picked.join(hits, "doc_id").select("doc_id", "text", "fixes").mapInArrow(_mend, "doc_id long, restored_text string, n_damaged long, n_lost long")
