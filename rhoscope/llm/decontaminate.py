"""Benchmark decontamination with one Aho-Corasick automaton, whatever the size of the benchmark.

Benchmark texts and documents are normalised alike: A-Z lower-cased, all but words left out. A word of the
benchmark becomes its number in as many digits as the largest needs, each place with digits of its own, and a word
that it lacks as many other characters, so a document becomes a short line that is scanned once. Every window of ``window`` words of an item
has, whole within it, one of the item's runs of (window + 1) / 2 words that start at multiples of that length; the
automaton holds these runs, so it has a few states per word of the benchmark. Where a run is met, the windows of
the document around it are looked up among the benchmark's windows, by hash and then character by character. An
item of fewer words than a window is a window of its own. Hits are numbers of words; those of documents that have
any are mapped to code points of the original text.

No rows are shuffled: the automaton goes to the executors, some 250 bytes per word of the benchmark. A benchmark of
over ``most_chars`` characters is refused, as the automaton must fit a worker; nothing is left out or cut.

Cases: a null text or one without words has no words, no hits and isn't contaminated; items without words
have no windows; items with one id count once; a null item_id counts as the empty string; repeated documents
are scanned apart; an empty benchmark gives no hits; further columns are ignored.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of words stay (A-Z lower-cased, 0-9, a-z, all of non-ASCII characters), others become spaces.
NORMAL = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Few digits, as a state's arcs are searched one by one.
DIGITS = 32


def normal_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(NORMAL).split()


def name_of(line: str) -> int:
    return xxhash.xxh64_intdigest(line.encode())


class Matcher:
    """The automaton, and the benchmark's windows that it leads to."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        import ahocorasick

        self.size, self.run, self.ids = size, (size + 1) // 2, sorted({item for item, _ in items})
        number = {item: i for i, item in enumerate(self.ids)}
        texts = [(number[item], words) for item, text in items if (words := normal_words(text))]
        known = dict.fromkeys(w for _, words in texts for w in words)
        self.wide = 1
        while DIGITS**self.wide < len(known):
            self.wide += 1
        self.signs = {w: "".join(chr(1 + k * DIGITS + i // DIGITS**k % DIGITS) for k in range(self.wide)) for i, w in enumerate(known)}
        #: Of a word that the benchmark lacks.
        self.other = "\0" * self.wide
        lines = [(i, self.line(words)) for i, words in texts]
        self.book = "".join(line for _, line in lines)
        # Lengths in words of what to look up around a pattern; 0 stands for the windows around a run.
        patterns: dict[str, set[int]] = {}
        names, places, lengths, owners, at = [], [], [], [], 0
        for i, line in lines:
            n = len(line) // self.wide
            if n < size:
                patterns.setdefault(line, set()).add(n)
            for k in range(0, n - self.run + 1 if n >= size else 0, self.run):
                patterns.setdefault(self.part(line, k, self.run), set()).add(0)
            for k in range(max(1, n - size + 1)):
                names.append(name_of(self.part(line, k, min(n, size))))
                places.append(at + k * self.wide)
                lengths.append(min(n, size))
                owners.append(i)
            at += len(line)
        names = np.array(names, np.uint64)
        order = np.argsort(names, kind="stable")
        self.names, first = np.unique(names[order], return_index=True)
        self.places, self.lengths = np.array(places, np.int64)[order][first], np.array(lengths, np.int32)[order][first]
        self.owners, self.edges = np.array(owners, np.int32)[order], np.r_[first, names.size]
        self.machine = ahocorasick.Automaton()
        for p, kinds in patterns.items():
            self.machine.add_word(p, tuple(sorted(kinds)))
        if patterns:
            self.machine.make_automaton()

    def line(self, words: list[bytes]) -> str:
        return "".join(map(self.signs.get, words, repeat(self.other)))

    def part(self, line: str, start: int, n: int) -> str:
        return line[start * self.wide : (start + n) * self.wide]

    def owners_of(self, window: str) -> np.ndarray:
        """Numbers of the items that have the window, an item once for each time it has it."""
        name = name_of(window)
        i = int(np.searchsorted(self.names, np.uint64(name)))
        if i == self.names.size or int(self.names[i]) != name or self.part(self.book, self.places[i] // self.wide, self.lengths[i]) != window:
            return self.owners[:0]
        return self.owners[self.edges[i] : self.edges[i + 1]]

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Word numbers [start, end) of the matches, and the ids of their items."""
        spans, found, tried = [], set(), set()
        if len(self.machine):
            line = self.line(words)
            for end, kinds in self.machine.iter(line):
                end = (end + 1) // self.wide
                for n in kinds:
                    around = [(end - n, n)] if n else [(s, self.size) for s in range(max(0, end - self.size), min(end - self.run, len(words) - self.size) + 1)]
                    for window in around:
                        if window not in tried:
                            tried.add(window)
                            owners = self.owners_of(self.part(line, *window))
                            if owners.size:
                                spans.append((window[0], sum(window)))
                                found.update(owners.tolist())
        return np.array(spans, np.int64).reshape(-1, 2), {self.ids[i] for i in found}


def merged(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of covered words."""
    if len(spans) < 2:
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.flatnonzero(np.r_[True, spans[1:, 0] > reach[:-1]])
    return np.stack([spans[first, 0], np.r_[reach[first[1:] - 1], reach[-1]]], 1)


def benchmark_items(benchmark: DataFrame, most_chars: int) -> list[tuple[str, str]]:
    """All (item, text), if they aren't too many for one automaton."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").filter("text is not null")
    size = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if size > most_chars:
        raise ValueError(f"the benchmark has {size} characters, more than the {most_chars} of one automaton")
    return sorted((r["item"], r["text"]) for r in rows.distinct().toLocalIterator())


def find_contamination(df: DataFrame, benchmark: DataFrame, window: int = 13, most_chars: int = 50_000_000, keep: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """Columns ``keep`` of every document, n_words, n_hit, longest (run of hit words), items (ids, sorted) and spans
    of hit words in the text.

    ``prefix`` goes before the names of the last five; of ``keep``, columns of the same names are left out.
    """
    own = [f"{prefix}{c}" for c in ("n_words", "n_hit", "longest", "items", "spans")]
    keep = tuple(c for c in dict.fromkeys(keep) if c not in own)
    columns = list(dict.fromkeys([*keep, "text"]))
    matcher = df.sparkSession.sparkContext.broadcast(Matcher(benchmark_items(benchmark, most_chars), window))
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def work(batches):
        for batch in batches:
            n_words, n_hit, longest, ids, places = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                words = normal_words(text) if text else []
                spans, found = matcher.value.scan(words) if words else (np.zeros((0, 2), np.int64), set())
                spans = merged(spans)
                sizes = spans[:, 1] - spans[:, 0]
                n_words.append(len(words))
                n_hit.append(int(sizes.sum()))
                longest.append(int(sizes.max(initial=0)))
                ids.append(sorted(found))
                at = [m.span() for m in WORD.finditer(text)] if len(spans) else []
                places.append([{"start": at[a][0], "end": at[b - 1][1]} for a, b in spans.tolist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(c, pa.int64()) for c in (n_words, n_hit, longest)), pa.array(ids, pa.list_(pa.string())), pa.array(places, span)], names=[*keep, *own])

    kinds = ("long", "long", "long", "array<string>", "array<struct<start:int,end:int>>")
    fields = [(c, df.schema[c].dataType.simpleString()) for c in keep]
    return df.select(*(f"`{c}`" for c in columns)).mapInArrow(work, ", ".join(f"`{n}` {k}" for n, k in [*fields, *zip(own, kinds, strict=True)]))


def is_contaminated(prefix: str = "") -> Column:
    """A twentieth of the words, at least, are hit."""
    hit = F.col(f"{prefix}n_hit")
    return (hit > 0) & (20 * hit >= F.col(f"{prefix}n_words"))


def has_passage(window: int = 13, prefix: str = "") -> Column:
    """A whole window of the benchmark, however long the document, or a twentieth of its words."""
    return (F.col(f"{prefix}longest") >= window) | is_contaminated(prefix)


#: The op7 digest in DuckDB.
DECONTAMINATION_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row_, doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') END AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS key FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT row_, n, i, array_to_string(w[i:i + n - 1], ' ') AS key FROM (SELECT row_, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT dw.row_, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.key = bw.key),
hit_words AS (SELECT row_, count(DISTINCT p) AS n_hit FROM (SELECT row_, unnest(range(i, i + n)) AS p FROM hits) GROUP BY row_),
hit_items AS (SELECT row_, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row_, item FROM hits) GROUP BY row_)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN hit_words USING (row_) LEFT JOIN hit_items USING (row_)
"""
