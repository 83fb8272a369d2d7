"""BPE encoding and decoding, long texts by tree concatenation.

The vocabulary file (its path is a parameter) is read on the driver and
broadcast: a public ``tokenizers`` JSON of the kind "NFC, one space, lower case;
words by a pattern; bytes; merges with a word end".  A word's merges are applied
here; each task keeps the words it met in a table of bounded size.

A text of more than ``LEAF`` characters is halved until its pieces fit.  The
pieces are rows, dealt over the cluster and encoded at the same time, wherever the
cuts fall, inside words too.  Then neighbours are joined, pairs of halves first:

*   Words.  The pattern looks ahead three characters at most, so words of the left
    half that end before that stand.  The window scanned anew begins at the first
    other word and grows until a word of it begins where one of the right half does.
*   Tokens.  A long unsplit word across the cut keeps its tokens on both sides: the
    last w of the left and the first w of the right are encoded anew, w doubling
    until the outermost tokens of the window are the old ones on both sides.  Every
    adjacent pair of tokens is then one that occurs in an encoding, which makes the
    sequence the encoding of the whole.

Decoding joins the tokens' strings as the library does for a file without decoder.

Cases: null or empty text: no tokens, an empty decoded text; the special tokens'
strings in a text are the special tokens; a null doc_id and repeated rows each keep
their row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kit

#: Characters of a piece.
LEAF = 65_536
#: Words kept with their tokens in a task.
KNOWN_WORDS = 200_000
#: A word of more bytes isn't kept, and is merged by a heap.
LONG_WORD = 48


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Encoder:
    """A vocabulary of the kind above."""

    def __init__(self, source: str):
        import regex

        conf = json.loads(source)
        model = conf["model"]
        if model["type"] != "BPE" or conf.get("post_processor") or conf.get("decoder"):
            raise ValueError("not a vocabulary of this kind")
        self.ids: dict[str, int] = dict(model["vocab"])
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in conf["added_tokens"]}
        self.strings = {i: s for s, i in (self.ids | self.special).items()}
        self.decimal = {i: str(i) for i in self.strings}
        letters = _byte_letters()
        self.byte = [self.ids[c] for c in letters]
        self.byte_end = [self.ids[c + self.end] for c in letters]
        self.letter_byte = {c: b for b, c in enumerate(letters)}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # A merge as one number: its rank, then the new token in the last 20 bits.
        self.merges = {(self.ids[a], self.ids[b]): r << 20 | self.ids[a + b] for r, (a, b) in enumerate(pairs)}
        self.none = 1 << 60
        words = next(p for p in conf["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(words["pattern"]["Regex"], regex.V0)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.odd_space = regex.compile("[\x1c-\x1f]")  # splits for Python, not for the pattern
        self.known = Known(self)

    def normal(self, text: str) -> str:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # letters are lowered one by one
        return text.lower()

    def segments(self, text: str) -> list[tuple[int, str]]:
        """(special id, "") or (-1, normal text), in order."""
        if self.cut is None or not any(s in text for s in self.special):
            return [(-1, self.normal(text))]
        parts = self.cut.split(text)
        return [(self.special[p], "") if i % 2 else (-1, self.normal(p)) for i, p in enumerate(parts) if p]

    def merge(self, ids: list[int]) -> list[int]:
        """Apply the merges, lowest rank first and leftmost among equals."""
        merges = self.merges
        if len(ids) <= LONG_WORD:
            none = self.none
            ranks = [merges.get(p, none) for p in zip(ids, ids[1:])]
            while ranks and (best := min(ranks)) != none:
                i = ranks.index(best)
                ids[i] = best & 0xFFFFF
                del ids[i + 1], ranks[i]
                if i:
                    ranks[i - 1] = merges.get((ids[i - 1], ids[i]), none)
                if i < len(ranks):
                    ranks[i] = merges.get((ids[i], ids[i + 1]), none)
            return ids
        n = len(ids)
        ids, after, before = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = m & 0xFFFFF, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (m := merges.get((ids[k], ids[after[k]]))):
                    heapq.heappush(heap, (m, k, ids[k], ids[after[k]]))
        return [x for x in ids if x >= 0]

    def word(self, word: str, closed: bool = True) -> list[int]:
        """Tokens of a word; ``closed``: its end is the end of the word."""
        raw = word.encode()
        ids = [self.byte[b] for b in raw]
        if closed:
            ids[-1] = self.byte_end[raw[-1]]
        return self.merge(ids)

    def entry(self, run: str) -> tuple[str, int, str]:
        """(ids, their number, decoded) of a run without white space."""
        if not run.isalpha():  # letters only are one word
            words = self.pattern.findall(run)
            if len(words) != 1:
                got = [self.known[w] for w in words]
                return " ".join([g[0] for g in got]), sum([g[1] for g in got]), " ".join([g[2] for g in got])
        ids = self.word(run)
        return " ".join([self.decimal[i] for i in ids]), len(ids), " ".join([self.strings[i] for i in ids])

    def text(self, text: str) -> list[tuple[str, int, str]]:
        """Entries of the runs and special tokens of a whole text."""
        out = []
        for special, part in self.segments(text):
            if special >= 0:
                out.append((str(special), 1, self.strings[special]))
            elif self.odd_space.search(part):
                out += [self.entry(w) for w in self.pattern.findall(part)]
            else:
                out += map(self.known.__getitem__, part.split())
        return out

    def atoms(self, ids: list[int]) -> list[int]:
        """Byte tokens of a token sequence of one word, its end last if it has it."""
        out = []
        for i in ids:
            s = self.strings[i]
            ended = bool(self.end) and s.endswith(self.end) and len(s) > len(self.end)
            letters = s[:-len(self.end)] if ended else s
            atoms = [self.ids[c] for c in letters]
            if ended:
                atoms[-1] = self.ids[letters[-1] + self.end]
            out += atoms
        return out

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Tokens of a word from those of its two parts."""
        w = 2
        while True:
            a, b = left[-w:], right[:w]
            new = self.merge(self.atoms(a) + self.atoms(b))
            if (w >= len(left) or new[0] == a[0]) and (w >= len(right) or new[-1] == b[-1]):
                return left[:-w] + new + right[w:] if w < len(left) else new + right[w:]
            w *= 2

    def close(self, ids: list[int]) -> list[int]:
        """Tokens of a finished word from those of the same letters without an end."""
        w = 2
        while True:
            atoms = self.atoms(ids[-w:])
            atoms[-1] = self.ids[self.strings[atoms[-1]] + self.end]
            new = self.merge(atoms)
            if w >= len(ids) or new[0] == ids[-w]:
                return ids[:-w] + new if w < len(ids) else new
            w *= 2

    def piece(self, text: str, last: bool) -> Piece:
        """A piece of a text; its last word stays open unless the text ends there."""
        found = [m.span() for m in self.pattern.finditer(text)]
        return Piece(text, [s for s, _ in found], [e for _, e in found],
                     [self.kept(text[s:e]) if last or e < len(text) else self.word(text[s:e], False) for s, e in found], last)

    def kept(self, word: str) -> list[int]:
        """Tokens of a whole word, by the table."""
        return list(map(int, self.known[word][0].split(" ")))

    def concat(self, a: Piece, b: Piece) -> Piece:
        """Both halves as one."""
        cut, text = len(a.text), a.text + b.text
        keep = len(a.starts)
        while keep and (a.ends[keep - 1] == cut or a.starts[keep - 1] + 3 > cut):
            keep -= 1
        begin = a.starts[keep] if keep < len(a.starts) else cut
        where = {cut + s: i for i, s in enumerate(b.starts)}
        starts, ends, tokens, at = a.starts[:keep], a.ends[:keep], a.tokens[:keep], len(b.starts)
        old = [(s, e, t) for s, e, t in zip(a.starts[keep:], a.ends[keep:], a.tokens[keep:])]
        for m in self.pattern.finditer(text, begin):
            s, e = m.span()
            if s >= cut and s in where:
                at = where[s]
                break
            starts.append(s)
            ends.append(e)
            tokens.append(self._across(text, s, e, cut, old, b, b.last or e < len(text)))
        starts += [cut + s for s in b.starts[at:]]
        ends += [cut + e for e in b.ends[at:]]
        return Piece(text, starts, ends, tokens + b.tokens[at:], b.last)

    def _across(self, text, s, e, cut, old, b, closed) -> list[int]:
        """Tokens of a word that a cut touches: of one old part on each side by a
        join, else (short, or parts that the pattern cuts otherwise) anew."""
        if e - s > LONG_WORD:
            left = next((t for x, y, t in old if x == s and y == min(cut, e)), None)
            if left is not None and e == cut:
                return self.close(left) if closed else left
            if left is not None and b.starts and b.starts[0] == 0 and cut + b.ends[0] == e:
                return self.join(left, b.tokens[0])
        return self.kept(text[s:e]) if closed else self.word(text[s:e], False)


class Known(dict):
    """Entries of the runs met so far."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, run: str) -> tuple[str, int, str]:
        got = self.encoder.entry(run)
        if len(run) <= LONG_WORD:
            if len(self) >= KNOWN_WORDS:
                self.clear()
            self[run] = got
        return got


class Piece:
    """Words of a piece of text: places and tokens."""

    def __init__(self, text, starts, ends, tokens, last):
        self.text, self.starts, self.ends, self.tokens, self.last = text, starts, ends, tokens, last


def halves(text: str) -> list[str]:
    """The text, halved until each piece has LEAF characters at most."""
    out, todo = [], [text]
    while todo:
        t = todo.pop()
        if len(t) <= LEAF:
            out.append(t)
        else:
            todo += [t[len(t) // 2:], t[:len(t) // 2]]
    return out


def tree(encoder: Encoder, pieces: list[Piece]) -> Piece:
    """Neighbours joined, level by level."""
    while len(pieces) > 1:
        pieces = [encoder.concat(*pieces[i:i + 2]) if i + 1 < len(pieces) else pieces[i] for i in range(0, len(pieces), 2)]
    return pieces[0]


def _digest(entries: list[tuple[str, int, str]]) -> tuple[int, str, str]:
    return (sum([e[1] for e in entries]), _sha(" ".join([e[0] for e in entries])), _sha(" ".join([e[2] for e in entries])))


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _ids(entries) -> tuple[list[int]]:
    return ([int(x) for ids, _, _ in entries for x in ids.split(" ")],)


#: What is made of a text's tokens: columns and function.
DIGEST = ("n_tokens long, ids_sha256 string, decoded_sha256 string", _digest)
TOKENS = ("ids array<int>", _ids)


def load(path: str | None = None) -> str:
    """The vocabulary file's text; by default that of the public word_bpe_49k."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def encode(docs: DataFrame, path: str | None = None, make=TOKENS) -> DataFrame:
    """doc_id and the columns of ``make`` of each row."""
    from ..session import ensure_checkpoint_dir

    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    vocabulary = spark.sparkContext.broadcast(load(path))
    schema, build = make
    names = _names(schema)
    piece_names = ["row", "seg", "k", "special", "piece", "ended"]

    loaded: list[Encoder] = []

    def whole(frames):
        """Short texts encoded; pieces of long ones."""
        from pyspark import TaskContext

        encoder, task, rows = Encoder(vocabulary.value), TaskContext.get().partitionId(), 0
        for f in frames:
            texts = [t if isinstance(t, str) else "" for t in f["text"]]
            for a, b in kit.chunks(texts, kit.CHUNK_BYTES // 2):
                out = []
                for doc, text in zip(f["doc_id"].iloc[a:b].tolist(), texts[a:b]):
                    doc = None if pd.isna(doc) else int(doc)
                    if len(text) <= LEAF:
                        out.append((doc, *build(encoder.text(text)), None, None, None, None, None, None))
                        continue
                    rows += 1
                    for seg, (special, part) in enumerate(encoder.segments(text)):
                        cut = halves(part)
                        out += [(doc, *[None] * len(names), f"{task}-{rows}", seg, k, special, p, k == len(cut) - 1)
                                for k, p in enumerate(cut)]
                frame = pd.DataFrame(out, columns=["doc_id", *names, *piece_names], dtype=object)
                yield frame

    def leaves(frames):
        """Words and tokens of each piece."""
        encoder = Encoder(vocabulary.value)
        for f in frames:
            got = [encoder.piece(p, bool(last)) if s < 0 else Piece("", [], [], [], True)
                   for s, p, last in zip(f["special"], f["piece"], f["ended"])]
            f = f.copy()
            f["starts"], f["ends"], f["tokens"] = ([getattr(g, c) for g in got] for c in ("starts", "ends", "tokens"))
            yield f

    def grown(f: pd.DataFrame) -> pd.DataFrame:
        """A text out of its pieces."""
        if not loaded:  # once for all texts of a task
            loaded.append(Encoder(vocabulary.value))
        encoder, out = loaded[0], []
        f = f.sort_values(["seg", "k"])
        for _, s in f.groupby("seg"):
            if s["special"].iloc[0] >= 0:
                i = int(s["special"].iloc[0])
                out.append((str(i), 1, encoder.strings[i]))
                continue
            pieces = [Piece(p, list(a), list(b), [list(t) for t in x], bool(last))
                      for p, a, b, x, last in zip(s["piece"], s["starts"], s["ends"], s["tokens"], s["ended"])]
            out += [(" ".join(map(str, t)), len(t), " ".join([encoder.strings[i] for i in t])) for t in tree(encoder, pieces).tokens]
        return pd.DataFrame([(f["doc_id"].iloc[0], *build(out))], columns=["doc_id", *names])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    piece_schema = "row string, seg int, k int, special int, piece string, ended boolean"
    both = kit.map_texts(docs, whole, f"doc_id long, {schema}, {piece_schema}").checkpoint()
    short = both.where("row is null").select("doc_id", *names)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    long = both.where("row is not null").select("doc_id", *piece_names).repartition(n, "row", "seg", "k")
    long = long.mapInPandas(leaves, f"doc_id long, {piece_schema}, starts array<int>, ends array<int>, tokens array<array<int>>")
    long = long.groupBy("row").applyInPandas(grown, f"doc_id long, {schema}")
    return short.unionAll(long)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` (doc_id, ids) with the decoded text; null ids: null."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(load(path))

    def run(frames):
        strings = Encoder(vocabulary.value).strings
        for f in frames:
            text = [None if i is None else " ".join([strings[x] for x in i]) for i in f["ids"]]
            yield pd.DataFrame({"doc_id": f["doc_id"], "text": text})
    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    """Digests of the tokens and of the decoded text of every document."""
    return encode(kit.table(spark, sf_dir, "documents"), make=DIGEST)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as tokens, decoded again for the digest."""
    return encode(docs, make=DIGEST)
