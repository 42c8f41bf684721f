"""Token ids of whole texts by a public tokenizer, with the words that recur looked up instead of encoded again."""

from __future__ import annotations

import re
import string
from collections.abc import Callable
from functools import lru_cache
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct pieces that a Python worker remembers; beyond that it forgets those it met once. Results don't depend on it.
REMEMBERED = 400_000

#: Characters that the library gets at once of a long text.
PART = 1 << 16

# After a letter these begin a word of their own in byte-level BPE; an apostrophe may not.
_MARKS = string.punctuation.replace("'", "")

# The character that stands for each byte in a byte-level vocabulary; line ends are kept, to part words.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
_CHARACTERS = np.zeros(256, np.uint32)
_CHARACTERS[_SHOWN] = _SHOWN
_CHARACTERS[_CHARACTERS == 0] = np.arange(256, 512 - len(_SHOWN))
_CHARACTERS[10] = 10

# A single space between two other characters: byte-level BPE never joins what is on its two sides.
_SAFE = re.compile(r"(?<=\S) (?=\S)")


def vocabulary_path(name: str) -> str:
    """The path of a vocabulary file by name, or the path itself."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class _Pieces(dict):
    """Numbers of pieces; looking up a new one gives it the next number and notes it."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []
        self.next = 0

    def __missing__(self, piece: str) -> int:
        number = self[piece] = self.next
        self.next += 1
        self.fresh.append(piece)
        return number


class _Letters(dict):
    """Whether a character is a letter to the library: then it makes one word with a letter before it."""

    def __init__(self, words: Callable[[str], list]):
        super().__init__()
        self.words = words

    def __missing__(self, character: str) -> bool:
        known = self[character] = len(self.words("a" + character)) == 1
        return known


class Encoder:
    """Encodes texts to ids exactly as the library does on the whole text, special strings included.

    The vocabularies split a text into words before anything else, so for byte-level ones a text is cut before single
    spaces (and line ends) between two other characters (a long text never has to be encoded at once), and each
    distinct piece is encoded once and remembered. Arrow cuts the texts and numbers the distinct pieces of a call, so Python
    meets each of them once a call; a piece of a word and marks is put together from the ids of both. Texts that hold a
    special string, and vocabularies of other kinds, are encoded whole by the library.
    """

    def __init__(self, name: str):
        path = vocabulary_path(name)
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._whole: Callable = lambda texts: model.encode(texts, num_threads=1)
            self._pieces, self._special = False, []
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self._whole = lambda texts: [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]
            split = repr(model.pre_tokenizer)
            self._pieces = model.normalizer is None and split.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in split
            if self._pieces:
                # In a byte-level vocabulary each character of a token stands for one byte.
                lengths = {i: len(t) for t, i in model.get_vocab(with_added_tokens=False).items()}
                self._token_bytes = np.array([lengths.get(i, 0) for i in range(max(lengths) + 1)], dtype=np.int64)
                self._tokens = model.model.tokenize
                self._letters = _Letters(model.pre_tokenizer.pre_tokenize_str)
            self._special = [t.content for t in model.get_added_tokens_decoder().values()]
        self._first, self._later = _Pieces(), _Pieces()
        self._ids, self._held = np.zeros(1 << 16, np.uint32), 0
        self._known = 0
        self._starts, self._sizes, self._met = (np.zeros(1 << 12, np.int64) for _ in range(3))
        self._odd = np.zeros(1 << 12, bool)

    def _forget(self) -> None:
        """Keep the pieces that were met more than once, or as often as it takes to keep half at most, renumbered."""
        met, least = self._met[: self._known], 2
        while np.count_nonzero(met >= least) > REMEMBERED // 2:
            least *= 2
        kept = np.flatnonzero(met >= least)
        number = np.full(self._known, -1)
        number[kept] = np.arange(len(kept))
        number = number.tolist()
        for known in (self._first, self._later):
            left = {p: n for p, k in known.items() if (n := number[k]) >= 0}
            known.clear()
            known.update(left)
        ids, sizes, odd = self._gather(kept), self._sizes[kept], self._odd[kept]
        self._known = self._held = 0
        self._add(self._hold(ids) + np.cumsum(sizes) - sizes, sizes, odd)
        self._met[: self._known] = 1

    def _add(self, starts: np.ndarray, sizes: np.ndarray, odd: np.ndarray) -> None:
        """Note the ids of the pieces with the next numbers."""
        begin, end = self._known, self._known + len(starts)
        while end > len(self._starts):
            self._starts, self._sizes, self._met, self._odd = (np.append(a, np.zeros_like(a)) for a in (self._starts, self._sizes, self._met, self._odd))
        self._starts[begin:end], self._sizes[begin:end], self._met[begin:end], self._odd[begin:end] = starts, sizes, 0, odd
        self._known = end

    def _learn(self, known: _Pieces, lead: str) -> None:
        """Find the ids of the pieces that got a number just now; those that are no single word (after a line end) are odd."""
        if not known.fresh:
            return
        begin, fresh, cut = self._known, known.fresh, []
        odd, single = self._are_odd(fresh, lead), np.fromiter(map(str.isalpha, fresh), bool, len(fresh))
        for i in np.flatnonzero(~single & ~odd).tolist():
            word = fresh[i].rstrip(_MARKS)
            if word and len(word) < len(fresh[i]) and self._letters[word[-1]]:
                cut.append((i, known[word], fresh[i][len(word) :]))  # a word not met yet is now at the end of `fresh`
        known.fresh, more = [], fresh[len(odd) :]
        odd, single = np.append(odd, np.zeros(len(more), bool)), np.append(single, np.array([w.isalpha() for w in more], bool))
        sizes, starts = np.zeros(len(fresh), np.int64), np.zeros(len(fresh), np.int64)
        if not all(map(self._letters.__getitem__, set("".join(compress(fresh, single & ~odd))))):
            single[:] = False
        mixed = ~single & ~odd
        mixed[[i for i, _, _ in cut]] = False
        for rows, encode in ((np.flatnonzero(single & ~odd), self._encode_words), (np.flatnonzero(mixed), self._encode_each)):
            for i in range(0, len(rows), 500):
                some = rows[i : i + 500]
                ids, sizes[some] = encode([fresh[k] for k in some.tolist()], lead)
                starts[some] = self._hold(ids) + np.cumsum(sizes[some]) - sizes[some]
        self._add(starts, sizes, odd)
        if cut:
            rows, words, marks = zip(*cut, strict=True)
            rows, words = np.array(rows) + begin, np.array(words)
            self._first.next = self._known
            ends = np.fromiter(map(self._first.__getitem__, marks), np.int64, len(marks))
            self._learn(self._first, "")
            both = np.column_stack([words, ends]).ravel()
            np.add.at(self._met, both, 1)
            self._sizes[rows] = self._sizes[words] + self._sizes[ends]
            self._starts[rows] = self._hold(self._gather(both)) + np.cumsum(self._sizes[rows]) - self._sizes[rows]

    def _are_odd(self, pieces: list[str], lead: str) -> np.ndarray:
        """Which pieces are not one word, with a line end before it at most; mostly none is, and one look at all tells."""
        joined = " ".join(pieces)
        words, ends = joined.split(), joined.count("\n") if lead == " " else 0  # line ends are only where pieces begin
        if len(words) == len(pieces) and sum(map(len, words)) == sum(map(len, pieces)) - ends:
            return np.zeros(len(pieces), bool)
        return np.array([len(w := p.split()) != 1 or len(w[0]) != len(p) - (p[0] == "\n" and lead == " ") for p in pieces])

    def _hold(self, ids: np.ndarray) -> int:
        """Remember ids, and tell where they begin."""
        begin, end = self._held, self._held + len(ids)
        while end > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        self._ids[begin:end] = ids
        self._held = end
        return begin

    def _encode_words(self, words: list[str], lead: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each has. Words of letters only need not be looked for in a text."""
        shown = _CHARACTERS[np.frombuffer((lead + ("\n" + lead).join(words)).encode(), np.uint8)].tobytes().decode("utf-32-le")
        tokens = [self._tokens(w) for w in shown.split("\n")]
        sizes = np.fromiter(map(len, tokens), np.int64, len(words))
        return np.array([t.id for found in tokens for t in found], dtype=np.uint32), sizes

    def _encode_each(self, pieces: list[str], lead: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in a row, and how many each has.

        Pieces that begin with their space or line end are encoded as one text. No token spans two of them, so the
        bytes of the tokens tell which piece each belongs to.
        """
        pieces = [p if p[:1] == "\n" else lead + p for p in pieces]
        if pieces[0][0] in " \n":
            found = np.fromiter(self._whole(["".join(pieces)])[0], np.uint32)
            joined = np.frombuffer("".join(pieces).encode(), np.uint8)
            ends = np.append(np.flatnonzero((joined == 32) | (joined == 10))[1:], len(joined))
            reach = np.cumsum(self._token_bytes[found])
            last = np.searchsorted(reach, ends) + 1
            if len(last) == len(pieces) and last[-1] == len(found) and (reach[last - 1] == ends).all():
                return found, np.diff(last, prepend=0)
        each = self._whole(pieces)
        sizes = np.fromiter(map(len, each), np.int64, len(pieces))
        return np.fromiter(chain.from_iterable(each), np.uint32, int(sizes.sum())), sizes

    def _numbers(self, texts: pa.Array):
        """The piece numbers of all texts in a row, how many each text has, and the texts left to the library.

        Pieces are encoded independently if each is a single word: the first of a text as it is, later ones with a space
        before them, or with the line end they begin with.
        """
        filled = pc.greater(pc.fill_null(pc.binary_length(texts), 0), 0)
        cuts = filled if self._pieces else pc.and_(filled, False)
        for special in self._special if self._pieces else ():
            cuts = pc.and_(cuts, pc.invert(pc.fill_null(pc.match_substring(texts, special), False)))
        if self._known > REMEMBERED:
            self._forget()
        cut = pc.split_pattern(pc.replace_substring(texts.filter(cuts), "\n", " \n"), " ")
        cuts, sizes = cuts.to_numpy(zero_copy_only=False), np.zeros(len(texts), np.int64)
        sizes[cuts] = pc.list_value_length(cut).to_numpy()
        numbers = self._look_up(cut.flatten(), (np.cumsum(sizes) - sizes)[sizes > 0])
        odd = np.flatnonzero(self._odd[numbers])
        if len(odd):
            left = np.unique(np.searchsorted(np.cumsum(sizes), odd, "right"))
            own = np.repeat(np.isin(np.arange(len(sizes)), left), sizes)
            numbers, sizes[left], cuts[left] = numbers[~own], 0, False
        self._met += np.bincount(numbers, minlength=len(self._met))
        whole = np.flatnonzero(filled.to_numpy(zero_copy_only=False) & ~cuts).tolist()
        return numbers, sizes, [(i, texts[i].as_py()) for i in whole]

    def _by_library(self, text: str) -> list[int]:
        """A text that is not all single words, in parts of about PART characters if it may be cut."""
        if not self._pieces or any(s in text for s in self._special):
            return self._whole([text])[0]
        at, parts = 0, []
        while cut := _SAFE.search(text, at + PART):
            parts.append(text[at : cut.start()])
            at = cut.start()
        return list(chain.from_iterable(self._whole([*parts, text[at:]])))

    def _look_up(self, pieces: pa.Array, firsts: np.ndarray) -> np.ndarray:
        """The numbers of pieces, of which some are the first of their text; new ones are learned."""
        coded = pieces.dictionary_encode()
        indices, distinct = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False)
        leading = indices[firsts]
        later = np.flatnonzero(np.bincount(indices, minlength=len(distinct)) > np.bincount(leading, minlength=len(distinct)))
        found = np.zeros(len(distinct), np.int64)
        self._first.next = self._known
        first = np.fromiter(map(self._first.__getitem__, distinct[leading]), np.int64, len(leading))
        self._learn(self._first, "")
        self._later.next = self._known
        found[later] = np.fromiter(map(self._later.__getitem__, distinct[later]), np.int64, len(later))
        self._learn(self._later, " ")
        numbers = found[indices]
        numbers[firsts] = first
        return numbers

    def counts(self, texts: list[str | None] | pa.Array) -> list[int]:
        """The number of ids of each text; null: 0."""
        numbers, sizes, whole = self._numbers(_wide(texts))
        totals = np.append(0, np.cumsum(self._sizes[numbers]))
        ends = np.cumsum(sizes)
        found = (totals[ends] - totals[ends - sizes]).tolist()
        for i, text in whole:
            found[i] = len(self._by_library(text))
        return found

    def ids(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        """The ids of each text; null: none."""
        numbers, sizes, whole = self._numbers(_wide(texts))
        flat = self._gather(numbers)
        totals = np.append(0, np.cumsum(self._sizes[numbers]))
        ends = np.cumsum(sizes)
        found = [flat[a:b] for a, b in zip(totals[ends - sizes].tolist(), totals[ends].tolist(), strict=True)]
        for i, text in whole:
            found[i] = np.array(self._by_library(text), dtype=np.uint32)
        return found

    def _gather(self, numbers: np.ndarray) -> np.ndarray:
        sizes = self._sizes[numbers]
        if not len(sizes):
            return np.zeros(0, np.uint32)
        ends = np.cumsum(sizes)
        return self._ids[np.repeat(self._starts[numbers] - ends + sizes, sizes) + np.arange(ends[-1])]


def _wide(texts: list[str | None] | pa.Array) -> pa.Array:
    """Texts with 64-bit offsets, so that line ends may grow."""
    return texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())


@lru_cache(maxsize=4)
def encoder(name: str) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    return Encoder(name)
