"""Queries folded over a block of documents: the task side of ``search``.

Spark brings the postings that a batch of queries needs together by document;
a task holds some thousand documents. Here the clauses of each query are added
up in one score per document of the block and the best ``k`` of the block are
passed on, so no row is made for a pair of query and document. Phrases of the
whole batch are found in one walk over the block's places (``phrase_hits``):
the work follows the places, not the number of phrases.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


@dataclass
class Batch:
    """What every task knows: queries (id, k, clauses by field), idf of (field, term), average lengths, BM25's k1 and b."""
    queries: list
    idf: dict
    avgdl: dict
    k1: float
    b: float
    digits: int
    phrases: dict = field(default_factory=lambda: defaultdict(set))  # field: {(terms, slop, last word is a prefix)}


def _numbered(values: pa.Array) -> tuple[np.ndarray, list]:
    """Numbers of the values in byte order, nulls first, and the values."""
    coded = values.dictionary_encode("encode")
    order = pc.sort_indices(coded.dictionary, null_placement="at_start").to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[coded.indices.to_numpy(zero_copy_only=False)], coded.dictionary.take(pa.array(order))


class Block:
    """The postings of some documents, sorted by field, term and document."""

    def __init__(self, rows: pa.Table, batch: Batch):
        self.batch = batch
        self.doc, self.ids = _numbered(rows["doc_id"].combine_chunks())
        self.size = len(self.ids)
        real = rows["field"].is_valid().to_numpy()
        if not real.all():
            rows, self.doc = rows.filter(pa.array(real)), self.doc[real]
        at, fields = _numbered(rows["field"].combine_chunks())
        term, words = _numbered(rows["term"].combine_chunks())
        order = np.lexsort((self.doc, term, at))
        self.doc, at, self.term = self.doc[order], at[order], term[order]
        tf, self.dl = (rows[c].to_numpy()[order].astype(float) for c in ("tf", "dl"))
        average = np.array([batch.avgdl.get(f, 1.0) for f in fields.to_pylist()] or [1.0])[at]
        self.norm = batch.k1 * (1.0 - batch.b + batch.b * self.dl / average)
        self.part = (batch.k1 + 1.0) * tf / (tf + self.norm)
        self.words = [w.encode() for w in words.to_pylist()]
        self.terms, self.starts, self.hits = {}, {}, {}
        for no, f in enumerate(fields.to_pylist()):
            lo, hi = np.searchsorted(at, [no, no + 1])
            new = np.flatnonzero(np.r_[True, self.term[lo + 1:hi] != self.term[lo:hi - 1]]) + lo
            self.terms[f] = [self.words[t] for t in self.term[new]]
            self.starts[f] = np.r_[new, hi]
            if batch.phrases.get(f):
                places = rows["positions"].combine_chunks().take(pa.array(order[lo:hi]))
                n, pos = np.diff(places.offsets.to_numpy()), places.flatten().to_numpy()
                self.hits.update({(f, key): v for key, v in phrase_hits(
                    batch.phrases[f], self.words, np.repeat(np.arange(lo, hi), n), pos, self.doc, self.dl, self.term).items()})
        same = (self.doc[1:] == self.doc[:-1]) & (self.term[1:] == self.term[:-1]) & (at[1:] == at[:-1])
        self.copies = bool(same.any())  # a document twice under a term: ids that repeat with texts of other lengths

    def rows(self, f: str, lo: bytes, hi: bytes | None = None) -> slice:
        """The postings of the term ``lo``, or of the terms from ``lo`` to ``hi``."""
        terms = self.terms.get(f)
        if terms is None:
            return slice(0, 0)
        a, b = bisect_left(terms, lo), bisect_right(terms, lo if hi is None else hi)
        return slice(self.starts[f][a], self.starts[f][max(a, b)])

    def beginning(self, f: str, start: bytes) -> slice:
        """The postings of the terms that begin with ``start``."""
        terms = self.terms.get(f)
        if terms is None:
            return slice(0, 0)
        a, b = bisect_left(terms, start), bisect_left(terms, start + b"\xff")  # no byte of UTF-8
        return slice(self.starts[f][a], self.starts[f][max(a, b)])

    def add(self, score: np.ndarray, doc: np.ndarray, more: np.ndarray) -> None:
        if self.copies:
            np.add.at(score, doc, more)
        else:
            score[doc] += more

    def clause(self, c: dict, score: np.ndarray | None) -> np.ndarray:
        """The documents (marked) that a clause takes in its field; their scores are added to ``score``."""
        taken, kind, f, terms = np.zeros(self.size, bool), c["kind"], c["field"], c["terms"]
        if kind in ("term", "exact"):
            for t in dict.fromkeys(terms):
                at = self.rows(f, t)
                taken[self.doc[at]] = True
                if score is not None and at.stop > at.start:
                    self.add(score, self.doc[at], c["boost"] * self.batch.idf[f, t] * self.part[at])
            return taken
        if kind == "phrase":
            doc, dl, n = self.hits.get((f, (terms, c["slop"], False)), (np.zeros(0, int),) * 3)
            taken[doc] = True
            if score is not None and len(doc):
                norm = self.batch.k1 * (1.0 - self.batch.b + self.batch.b * dl / self.batch.avgdl.get(f, 1.0))
                weight = c["boost"] * sum(self.batch.idf[f, t] for t in terms)
                np.add.at(score, doc, weight * (self.batch.k1 + 1.0) * n / (n + norm))
            return taken
        if kind == "set":
            found = [self.rows(f, t) for t in set(terms)]
        elif kind == "range":
            found = [self.rows(f, terms[0], terms[1])] if len(terms) > 1 and terms[0] <= terms[1] else []
        elif kind == "prefix" and len(terms) == 1:
            found = [self.beginning(f, terms[0])]
        else:
            found = []
            if len(terms) > 1:
                taken[self.hits.get((f, (terms, 0, True)), (np.zeros(0, int),))[0]] = True
        for at in found:
            taken[self.doc[at]] = True
        if score is not None:
            score[taken] += c["boost"]
        return taken

    def best(self, q: dict) -> tuple[np.ndarray, np.ndarray]:
        """The documents of a query's k best scores in this block, and the scores."""
        score, should = np.full(self.size, float(q["base"])), np.full(self.size, q["any"])
        keep = np.ones(self.size, bool)
        musts, filters = {}, None
        for c in q["clauses"]:
            taken = self.clause(c, None if c["occur"] == "must_not" else score)
            if c["occur"] == "must_not":
                keep &= ~taken
            elif c["occur"] == "should":
                should |= taken
            elif c["occur"] == "must":
                musts[c["clause_no"]] = musts[c["clause_no"]] | taken if c["clause_no"] in musts else taken
            else:
                filters = taken if filters is None else filters | taken
        for taken in musts.values():
            keep &= taken
        if filters is not None:
            keep &= filters
        if not musts:
            keep &= should
        doc = np.flatnonzero(keep)
        score, k, ten = score[doc], q["k"], 10.0 ** self.batch.digits
        if len(doc) > k:
            near = np.sign(score) * np.floor(np.abs(score) * ten + 0.5) / ten
            least = -np.partition(-near, k - 1)[k - 1]
            above, level = np.flatnonzero(near > least), np.flatnonzero(near == least)
            at = np.r_[above, level[:k - len(above)]]  # documents are in id order
            doc, score = doc[at], score[at]
        return doc, score


def _children(tree: dict, codes: np.ndarray, missing: int = -1) -> np.ndarray:
    """The values of ``codes`` in ``tree`` (code: value)."""
    if not tree or not len(codes):
        return np.full(len(codes), missing)
    keys = np.fromiter(tree, np.int64, len(tree))
    order = np.argsort(keys)
    keys, values = keys[order], np.fromiter(tree.values(), np.int64, len(tree))[order]
    at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
    return np.where(keys[at] == codes, values[at], missing)


def phrase_hits(phrases: set, words: list, row: np.ndarray, pos: np.ndarray, doc: np.ndarray, dl: np.ndarray, term: np.ndarray) -> dict:
    """{phrase: (documents, lengths, number of last places)} of phrases (terms, slop, last word is a prefix) in one field.

    ``pos`` are places of the postings ``row``. Phrases are one tree of words;
    all places walk down it together. Of the ways to one node at one place
    only the one that began last is kept, which is the narrowest.
    """
    if not len(pos):
        return {}
    number = {w: i for i, w in enumerate(words)}
    wide = len(words) + 1
    tree, ends, last, count = defaultdict(dict), {}, defaultdict(lambda: defaultdict(dict)), 1
    for phrase in phrases:
        terms, _, by_prefix = phrase
        node, fixed = 0, terms[:-1] if by_prefix else terms
        for level, w in enumerate(fixed):
            code = node * wide + number.get(w, len(words))  # a word the block lacks leads nowhere
            if code not in tree[level]:
                tree[level][code] = count
                count += 1
            node = tree[level][code]
        if by_prefix:
            last[len(fixed)][len(terms[-1])].setdefault((node, terms[-1]), []).append(phrase)
        else:
            ends.setdefault(node, []).append(phrase)
    _, unit = np.unique(np.stack([doc[row], dl[row].astype(np.int64)]), axis=1, return_inverse=True)
    unit = unit.ravel()
    span = int(pos.max()) + 2 + max(s for _, s, _ in phrases)
    key, what = unit * span + pos, term[row]
    order = np.lexsort((what, key))
    key, what, row, pos = key[order], what[order], row[order], pos[order]
    new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (what[1:] != what[:-1])])
    times = np.diff(np.r_[new, len(key)])  # a place that stands in several copies of an id counts for each
    key, what, row, pos = key[new], what[new], row[new], pos[new]
    deep = int(np.bincount(np.unique(key, return_inverse=True)[1]).max())  # terms at one place: 1, but for copies
    out = defaultdict(list)
    # texts that hold a place more than once, being copies of an id: phrases without slop are counted apart
    repeated = np.isin(key // span, np.unique(key[times > 1] // span))
    # a walk: the node reached, the place it stands at, where it began
    at = np.arange(len(key))
    node, begun = _children(tree[0], what), pos
    walk = [x[node >= 0] for x in (node, at, begun)]
    steps = max(s for _, s, _ in phrases) + 1

    def reached(walk, named, by):
        """Notes the phrases of a level: ``by`` numbers what a walk has reached, ``named`` its phrases."""
        value, at, begun = walk
        if not named or not len(value):
            return
        order = np.lexsort((at, value))
        value, at, begun = value[order], at[order], begun[order]
        first = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
        for a, b in zip(first, np.r_[first[1:], len(value)], strict=True):
            for phrase in named.get(by(value[a]), ()):
                terms, slop, _ = phrase
                fits = pos[at[a:b]] - begun[a:b] <= len(terms) - 1 + slop
                if slop == 0:
                    fits &= ~repeated[at[a:b]]
                if fits.any():
                    out[phrase].append(at[a:b][fits])

    def ahead(walk):
        """(node, place, begin) of every walk and every place that its next word may stand at."""
        node, at, begun = walk
        for gap in range(1, steps + 1):
            place = np.searchsorted(key, key[at] + gap)
            for more in range(deep):
                to = np.minimum(place + more, len(key) - 1)
                there = key[to] == key[at] + gap
                yield node[there], to[there], begun[there]

    for level in range(1, max(len(t) for t, _, _ in phrases) + 1):
        reached(walk, ends, int)
        if not len(walk[0]):
            break
        for size, named in last[level].items():
            # prefixes are numbered by the node before and the prefix
            starts = {p: i for i, p in enumerate(dict.fromkeys(p for _, p in named))}
            begins = np.array([starts.get(w[:size], -1) for w in words])
            codes = {n * len(starts) + starts[p]: i for i, (n, p) in enumerate(named)}
            called = dict(enumerate(named.values()))
            for n, to, begun in ahead(walk):
                one = pos[to] - begun == level  # these phrases have no slop
                start = begins[what[to]]
                value = np.where((start >= 0) & one, _children(codes, n * len(starts) + start), -1)
                reached([x[value >= 0] for x in (value, to, begun)], called, int)
        if not tree[level]:
            break
        parts = []
        for n, to, begun in ahead(walk):
            child = _children(tree[level], n * wide + what[to])
            parts.append([x[child >= 0] for x in (child, to, begun)])
        node, at, begun = (np.concatenate(x) for x in zip(*parts, strict=True))
        if len(parts) > 1:
            order = np.lexsort((-begun, at, node))
            node, at, begun = node[order], at[order], begun[order]
            kept = np.r_[True, (node[1:] != node[:-1]) | (at[1:] != at[:-1])] if len(node) else np.zeros(0, bool)
            node, at, begun = node[kept], at[kept], begun[kept]
        walk = [node, at, begun]

    hits = {}
    for phrase, found in out.items():
        places = np.concatenate(found)
        units, inverse = np.unique(key[places] // span, return_inverse=True)
        first = np.zeros(len(units), np.int64)
        first[inverse] = row[places]
        hits[phrase] = (doc[first], dl[first], np.bincount(inverse, weights=times[places]))
    if repeated.any():
        own = ((key // span)[repeated], pos[repeated], what[repeated], times[repeated], row[repeated])
        for phrase, (_, n, at) in _repeated_hits(phrases, words, *own).items():
            old = hits.get(phrase, (np.zeros(0, doc.dtype), np.zeros(0, dl.dtype), np.zeros(0)))
            hits[phrase] = tuple(np.concatenate(x) for x in zip(old, (doc[at], dl[at], n), strict=True))
    return hits


def _repeated_hits(phrases: set, words: list, unit: np.ndarray, pos: np.ndarray, what: np.ndarray, times: np.ndarray, row: np.ndarray) -> dict:
    """{phrase: (units, number of places, a row of each)} of phrases without slop where copies of an id repeat places.

    As in ``match``, a phrase of n words stands at a place where n of the
    copies' words, each at its place, are the phrase's.
    """
    number = {w: i for i, w in enumerate(words)}
    long = max(len(t) for t, _, _ in phrases)
    span = int(pos.max()) + long + 1
    out = {}
    for terms, slop, by_prefix in phrases:
        if slop:
            continue
        fits = [what == number.get(w, -1) for w in terms]
        if by_prefix:
            fits[-1] = np.isin(what, [i for i, w in enumerate(words) if w.startswith(terms[-1])])
        at = [np.flatnonzero(x) for x in fits]
        start, inverse = np.unique(np.concatenate([unit[x] * span + pos[x] + long - i for i, x in enumerate(at)]), return_inverse=True)
        if not len(start):
            continue
        found = start[np.bincount(inverse, weights=np.concatenate([times[x] for x in at])) == len(terms)] // span
        if not by_prefix:  # every word is in the text
            for x in at:
                found = found[np.isin(found, unit[x])]
        units, n = np.unique(found, return_counts=True)
        if len(units):
            known, first = np.unique(unit, return_index=True)
            out[terms, slop, by_prefix] = units, n.astype(float), row[first[np.searchsorted(known, units)]]
    return out


def best_of_blocks(batch: Batch):
    """The function for ``mapInArrow``: a partition of postings in, (query_id, doc_id, score, k) of its best documents out."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for r in rows if r.num_rows]
        if not rows:
            return
        block = Block(pa.Table.from_batches(rows), batch)
        del rows
        for some in range(0, len(batch.queries), 1000):
            found = [(q, *block.best(q)) for q in batch.queries[some:some + 1000]]
            n = [len(doc) for _, doc, _ in found]
            doc = np.concatenate([doc for _, doc, _ in found])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat([q["query_id"] for q, _, _ in found], n).astype(np.int64)), block.ids.take(pa.array(doc)),
                 pa.array(np.concatenate([s for _, _, s in found])), pa.array(np.repeat([q["k"] for q, _, _ in found], n).astype(np.int32))],
                ["query_id", "doc_id", "score", "k"])

    return run
