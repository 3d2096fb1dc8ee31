"""Documents as rows, and query lists matched with them: what a batch of queries does in Arrow batches.

A list is the known terms of queries that ask for the same. A document comes as one row with all its terms, so its whole score
is computed where it is scanned, and nothing of a match is shuffled but the scores that can be among a list's best.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Pairs of documents and lists scored at once.
PAIRS = 500_000
# Slack of the search for sources: more than what packing a term and a number into one double loses.
SLACK = 1e-7
DOCUMENT = "doc_id bigint, dl bigint, terms array<string>, tfs array<bigint>"
_DOCUMENT = pa.schema([("doc_id", pa.int64()), ("dl", pa.int64()), ("terms", pa.list_(pa.string())), ("tfs", pa.list_(pa.int64()))])
_NONE = np.iinfo(np.int64).min


def document_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A DOCUMENT of each docid from records (term, docid, chunk_no, tf), ordered by docid: repeats of a record count once, a null tf adds nothing."""
    kept: list[pa.RecordBatch] = []  # of the last document, which may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        docid = batch["docid"].to_numpy()
        begins = int(np.searchsorted(docid, docid[-1]))  # where the last one begins
        if kept and (begins or kept[-1]["docid"][-1].as_py() != docid[-1]):
            yield _documents([*kept, batch.slice(0, begins)])
            kept = []
        elif begins:
            yield _documents([batch.slice(0, begins)])
        kept.append(batch.slice(begins))
    if kept:
        yield _documents(kept)


def _documents(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(parts).combine_chunks()
    coded = pc.dictionary_encode(rows["term"].combine_chunks())
    number = lambda name: np.asarray(pc.fill_null(rows[name].cast(pa.int64()), _NONE).to_numpy(), np.int64)
    docid, chunk, tf = number("docid"), number("chunk_no"), number("tf")
    size = len(coded.dictionary)
    posting = np.cumsum(np.append(False, docid[1:] != docid[:-1])) * size + np.asarray(coded.indices.to_numpy(zero_copy_only=False), np.int64)
    order = np.lexsort((tf, chunk, posting))
    posting, chunk, tf = posting[order], chunk[order], tf[order]
    new = np.append(True, posting[1:] != posting[:-1])
    first = new | np.append(True, (chunk[1:] != chunk[:-1]) | (tf[1:] != tf[:-1]))
    tf = np.add.reduceat(np.where(first & (tf != _NONE), tf, 0), np.flatnonzero(new))
    doc, term = np.divmod(posting[new], size)
    starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    offsets = pa.array(np.append(starts, len(doc)), pa.int32())
    terms = pa.ListArray.from_arrays(offsets, coded.dictionary.take(pa.array(term)))
    columns = [pa.array(docid[np.append(True, docid[1:] != docid[:-1])]), pa.array(np.add.reduceat(tf, starts)), terms, pa.ListArray.from_arrays(offsets, pa.array(tf))]
    return pa.RecordBatch.from_arrays(columns, schema=_DOCUMENT)


@dataclass
class Lists:
    """The terms of a block of lists, as arrays.

    term, value and start hold the lists' terms (positions in vocabulary), their factors and where each list begins; least is the score a
    list's best documents reach at least, needed how many terms a document must have. key, of and first are the sources: a
    term finds a list's documents where its weight reaches a bound, and each term's bounds lie in ascending order.
    """

    vocabulary: pa.Array
    ids: np.ndarray
    term: np.ndarray
    value: np.ndarray
    start: np.ndarray
    least: np.ndarray
    needed: np.ndarray
    key: np.ndarray
    of: np.ndarray
    first: np.ndarray

    @staticmethod
    def of_rows(rows: pa.Table, most: float) -> Lists:
        """rows (list, term, value, bound, least, needed), one per term of a list; most is the largest weight there is."""
        rows = rows.sort_by([("list", "ascending"), ("term", "ascending")])
        coded = rows["term"].combine_chunks().dictionary_encode()
        column = lambda name, kind: np.asarray(rows[name].to_numpy(), dtype=kind)
        term = np.asarray(coded.indices.to_numpy(zero_copy_only=False), np.int64)
        ids, start, of = np.unique(column("list", np.int64), return_index=True, return_inverse=True)
        key = term * 4 + np.clip(column("bound", np.float64) / most, 0, 2) - SLACK
        order = np.argsort(key, kind="stable")
        first = np.searchsorted(term[order], np.arange(len(coded.dictionary) + 1))
        least, needed = column("least", np.float64)[start], column("needed", np.int64)[start]
        return Lists(coded.dictionary, ids, term, column("value", np.float64), np.append(start, len(term)), least, needed, key[order], of[order], first)


def _expanded(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of counts repeated so often: which it is, and the how manieth."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)


def _scored(x: Lists, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, sources: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, lists and scores of postings, ordered by document and term, with so many sources each."""
    which, nth = _expanded(sources)
    found, listed = doc[which], x.of[x.first[term[which]] + nth]
    found, listed = np.divmod(np.unique(found * len(x.ids) + listed), len(x.ids))
    pair, nth = _expanded((x.start[1:] - x.start[:-1])[listed])
    at = x.start[listed[pair]] + nth
    size = len(x.vocabulary)
    postings, wanted = doc * size + term, found[pair] * size + x.term[at]
    place = np.minimum(np.searchsorted(postings, wanted), len(postings) - 1)
    there = postings[place] == wanted
    score = np.bincount(pair[there], weights=x.value[at[there]] * weight[place[there]], minlength=len(found))
    n = np.bincount(pair[there], minlength=len(found))
    keep = (score >= x.least[listed]) & (n >= x.needed[listed])
    return found[keep], listed[keep], score[keep]


def matches(shared, k1: float, b: float, avgdl: float):
    """An Arrow function from documents (doc_id, dl, terms, tfs) to (list, doc_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x: Lists = shared.value
        for batch in batches:
            terms, tfs = batch["terms"], batch["tfs"]
            doc = np.asarray(pc.list_parent_indices(terms).to_numpy(zero_copy_only=False), np.int64)
            place = pc.index_in(pc.list_flatten(terms), value_set=x.vocabulary)
            known = np.asarray(place.is_valid().to_numpy(zero_copy_only=False), bool)
            doc, term = doc[known], np.asarray(place.fill_null(0).to_numpy(zero_copy_only=False), np.int64)[known]
            tf = np.asarray(pc.list_flatten(tfs).to_numpy(zero_copy_only=False), np.float64)[known]
            dl = np.asarray(batch["dl"].fill_null(0).to_numpy(zero_copy_only=False), np.float64)[doc]
            order = np.lexsort((term, doc))
            doc, term, tf, dl = doc[order], term[order], tf[order], dl[order]
            weight = np.zeros(len(doc))
            np.divide(tf * (k1 + 1.0), tf + k1 * (1.0 - b + b * dl / (avgdl or 1.0)), out=weight, where=dl > 0)
            sources = np.searchsorted(x.key, term * 4 + np.clip(weight / (k1 + 1.0), 0, 1), side="right") - x.first[term]
            done = np.cumsum(np.bincount(doc, weights=sources, minlength=batch.num_rows)) // PAIRS  # whole documents together
            ids = batch["doc_id"].to_numpy(zero_copy_only=False)
            for part in np.unique(done[doc]):
                here = slice(*np.searchsorted(done[doc], [part, part + 1]))
                found, listed, score = _scored(x, doc[here], term[here], weight[here], sources[here])
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(x.ids[listed]), pa.array(ids[found], pa.int64()), pa.array(score)], names=["list", "doc_id", "score"])

    return run
