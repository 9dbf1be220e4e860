"""Name similarity in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def token_set_scorer(most_cells: int = 1 << 21):
    """Vectorised ``(left, right) -> score`` from 0 to 100.

    Words are compared as sets: 100 if one name's words are all in the other,
    else the best edit similarity among shared words, shared + own words of the
    left and shared + own words of the right. Edit similarity counts insertions
    and deletions only, i.e. twice the longest common subsequence over both lengths.
    A null name has no words; without words on a side the score is 0.

    A batch is scored as a whole: names become ragged arrays of word numbers, shared
    words are found by set membership of ``(pair, word)``, and the common subsequences
    of all pairs advance together, one letter a step, a pair per NumPy lane and 64
    letters per machine word with carries between words. ``most_cells`` bounds the
    lanes of one step, hence the memory, for any length of name and size of alphabet.
    The helpers are nested so that the function travels to the workers by value.
    """
    def gather(start, length):
        """Indices of the ranges ``start .. start + length``, one after the other."""
        before = np.repeat(np.cumsum(length) - length, length)
        return np.arange(length.sum()) - before + np.repeat(start, length)

    def numbered_words(names: pd.Series):
        """Sorted distinct words, and the ascending word numbers of each name as a ragged array."""
        split = names.str.split().explode().dropna()
        words, number = np.unique(split.to_numpy(dtype=object), return_inverse=True)
        key = np.unique(split.index.to_numpy(dtype=np.int64) * max(len(words), 1) + number)
        owner, number = key // max(len(words), 1), key % max(len(words), 1)
        return words, number, np.bincount(owner, minlength=len(names))

    def lanes_of(chars, start, length, alphabet):
        """Ragged strings as a matrix; what is past an end is a letter of its own."""
        out = np.full((len(length), length.max()), alphabet, dtype=np.int64)
        lane = np.repeat(np.arange(len(length)), length)
        place = gather(np.zeros(len(length), dtype=np.int64), length)
        out[lane, place] = chars[gather(start, length)]
        return out

    def common_lengths(chars, a, b, alphabet):
        """Longest common subsequences of ``a`` and ``b``, each ``(start, length)`` into ``chars``."""
        swap = a[1] < b[1]  # a step per letter of the shorter one
        long = [np.where(swap, y, x) for x, y in zip(a, b)]
        short = [np.where(swap, x, y) for x, y in zip(a, b)]
        order = np.lexsort((short[1], (long[1] + 63) // 64))
        out = np.zeros(len(order), dtype=np.int64)
        done = 0
        while done < len(order):
            # lanes are sorted by machine words, so the last of a block needs the most of them
            size = len(order) - done
            while size > 1 and size * (alphabet + 1) * -(-int(long[1][order[done + size - 1]]) // 64) > most_cells:
                size = (size + 1) // 2
            block = order[done:done + size]
            done += size
            starts, sizes = long[0][block], long[1][block]
            n_words = -(-int(sizes.max()) // 64)
            holds = np.zeros((size, alphabet + 1, n_words), dtype=np.uint64)
            place = gather(np.zeros(size, dtype=np.int64), sizes)
            np.bitwise_or.at(
                holds, (np.repeat(np.arange(size), sizes), chars[gather(starts, sizes)], place >> 6),
                np.uint64(1) << (place & 63).astype(np.uint64))
            letters = lanes_of(chars, short[0][block], short[1][block], alphabet)
            row = np.full((size, n_words), ~np.uint64(0))
            lane = np.arange(size)
            for step in range(letters.shape[1]):
                hit = row & holds[lane, letters[:, step]]
                carry = np.zeros(size, dtype=np.uint64)
                for k in range(n_words):
                    added = row[:, k] + hit[:, k]
                    over = added < hit[:, k]
                    summed = added + carry
                    carry = (over | (summed < added)).astype(np.uint64)
                    row[:, k] = summed | (row[:, k] & ~hit[:, k])
            valid = np.clip(sizes[:, None] - 64 * np.arange(n_words), 0, 64)
            some = np.where(valid > 0, ~np.uint64(0) >> (64 - np.maximum(valid, 1)).astype(np.uint64), np.uint64(0))
            out[block] = sizes - np.bitwise_count(row & some).sum(axis=1, dtype=np.int64)
        return out

    def rests(number, pair, word_start, size, n):
        """The words joined by blanks, per pair, as ``(numbers of letters, start, length)``."""
        length = np.bincount(pair, weights=size[number] + 1, minlength=n).astype(np.int64)
        chars = gather(word_start[number], size[number] + 1)
        return chars, np.cumsum(length) - length, np.maximum(length - 1, 0)

    @F.pandas_udf(DoubleType())
    def token_set_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        n = len(left)
        number, distinct = pd.factorize(pd.concat([left, right], ignore_index=True).fillna(""))
        words, of_name, count = numbered_words(pd.Series(distinct, dtype=object))
        if not len(words):
            return pd.Series(np.zeros(n))
        first = np.cumsum(count) - count
        size = np.array([len(w) for w in words], dtype=np.int64)
        # every word is followed by a blank, so that words of a rest can be laid end to end
        spelled = np.frombuffer((" ".join(words) + " ").encode("utf-32-le", "surrogatepass"), dtype="<u4")
        letters, spelled = np.unique(spelled, return_inverse=True)
        word_start = np.cumsum(size + 1) - (size + 1)

        sides = []
        for name in (number[:n], number[n:]):
            pair = np.repeat(np.arange(n), count[name])
            sides.append((pair, of_name[gather(first[name], count[name])]))
        (pair_a, word_a), (pair_b, word_b) = sides
        key_a, key_b = pair_a * len(words) + word_a, pair_b * len(words) + word_b
        both_a = np.isin(key_a, key_b, assume_unique=True)
        both_b = np.isin(key_b, key_a, assume_unique=True)
        n_shared = np.bincount(pair_a[both_a], minlength=n)
        shared = np.bincount(pair_a[both_a], weights=size[word_a[both_a]], minlength=n) + n_shared - 1

        chars_a, start_a, size_a = rests(word_a[~both_a], pair_a[~both_a], word_start, size, n)
        chars_b, start_b, size_b = rests(word_b[~both_b], pair_b[~both_b], word_start, size, n)
        chars = spelled[np.concatenate([chars_a, chars_b])]
        open_ = (size_a > 0) & (size_b > 0)
        common = np.zeros(n, dtype=np.int64)
        if open_.any():
            common[open_] = common_lengths(
                chars, (start_a[open_], size_a[open_]),
                (start_b[open_] + len(chars_a), size_b[open_]), len(letters))
        # the shared words and a space lead both full strings, so that part is common and
        # only the rests need to be compared
        lead = np.where(n_shared > 0, shared + 1, 0)
        whole = 200.0 * (lead + common) / np.maximum(2 * lead + size_a + size_b, 1)
        alone = 200.0 * shared / np.maximum(shared + lead + np.minimum(size_a, size_b), 1)
        score = np.where(n_shared > 0, np.maximum(whole, alone), np.where(open_, whole, 0.0))
        return pd.Series(np.where((n_shared > 0) & ~open_, 100.0, score))

    # kept where it is written: a deterministic call would be moved below the
    # de-duplication of candidates and run once per duplicate
    return token_set_ratio.asNondeterministic()
