"""Words and pairs of words of documents, sorted and counted where the texts are: kernels for ``mapInArrow``.

Each works on about ``WORDS`` words of whole documents at a time, so its memory doesn't follow the batch, and its rows come in order of the words.
"""

from __future__ import annotations

#: Words that are sorted at a time.
WORDS = 1 << 20


def placed_words(kind: str):
    """The kernel for rows (doc_id, doc_start or null, w).

    ``words``: term, doc_id, pos, gpos, prev (place of the same word before in the document, null for the first).  ``places``: the same without gpos.  ``pairs``: t1, t2, doc_id, pos, prev of neighbouring words.
    ``counts``: term, doc_id, tf, n_tokens.  A function inside of a function, so that workers get it whole and need not import this package.
    """
    limit = WORDS

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def parts(batch):
            lists = batch.column(2)
            size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            total, lo = np.cumsum(size), 0
            while lo < len(size):
                hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + limit, "right")))
                yield batch.slice(lo, hi - lo), size[lo:hi]
                lo = hi

        for batch in batches:
            for part, size in parts(batch):
                coded = part.column(2).flatten().dictionary_encode()
                if not len(coded):
                    continue
                order = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).argsort()
                names, number = coded.dictionary.take(pa.array(order)), np.empty(len(order), np.int64)
                number[order] = np.arange(len(order))
                word = number[coded.indices.to_numpy()]
                row = np.repeat(np.arange(len(size)), size)
                pos = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
                if kind == "pairs":
                    at = np.flatnonzero(row[1:] == row[:-1])
                    word, row, pos = word[at] * len(names) + word[at + 1], row[at], pos[at]
                sort = np.lexsort((row, word))  # stable, so places stay in order
                word, row, pos = word[sort], row[sort], pos[sort]
                new = np.ones(len(word), bool)
                new[1:] = (word[1:] != word[:-1]) | (row[1:] != row[:-1])
                doc = part.column(0)
                if kind == "counts":
                    first = np.flatnonzero(new)
                    found = {"term": names.take(pa.array(word[first])), "doc_id": doc.take(pa.array(row[first])), "tf": pa.array(np.diff(np.append(first, len(word)))), "n_tokens": pa.array(size[row[first]])}
                else:
                    prev = pa.array(np.concatenate([[0], pos[:-1]]) if len(pos) else pos, mask=new)
                    if kind == "words":
                        gpos = part.column(1).to_numpy(zero_copy_only=False)[row] + pos
                        found = {"term": names.take(pa.array(word)), "doc_id": doc.take(pa.array(row)), "pos": pa.array(pos), "gpos": pa.array(gpos.astype(np.int64)), "prev": prev}
                    elif kind == "places":
                        found = {"term": names.take(pa.array(word)), "doc_id": doc.take(pa.array(row)), "pos": pa.array(pos), "prev": prev}
                    else:
                        t1, t2 = np.divmod(word, max(len(names), 1))
                        found = {"t1": names.take(pa.array(t1)), "t2": names.take(pa.array(t2)), "doc_id": doc.take(pa.array(row)), "pos": pa.array(pos), "prev": prev}
                table = pa.RecordBatch.from_pydict(found)
                for lo in range(0, table.num_rows, 1 << 18):
                    yield table.slice(lo, 1 << 18)

    return run
