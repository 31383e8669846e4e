"""Ids of whole texts from a public tokenizer, by way of the distinct chunks of a task.

Texts are cut only where the tokenizer can't join: at a space that starts a word (byte-level), or at spaces and line
feeds (word-level, which drops white space). The library normalises and splits a distinct chunk into its words once and
encodes a distinct word once; a text's ids are put together by index. The few texts with special-token strings, NUL or
irregular white space are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import compress, islice
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

SPACE = "\\t\\n\\x0b\\x0c\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
#: A space between other white space, where the byte-level pattern doesn't start a new token.
IRREGULAR = f"[{SPACE}] (?:[{SPACE}]|\\z)"
MAX_CHUNKS, MAX_WORDS = 400_000, 200_000  # distinct chunks and words that a worker remembers from one piece of text to the next
HEAD = "\x00"         # marks the first chunk of a text, which no space precedes
WALL = "\u010a"       # the byte-level letter for a line feed, a word of its own
_BEYOND = re.compile("[^\x00-\u012f]")
_BLANK = re.compile(r"\s")  # white space in what a space ends


@lru_cache(maxsize=4)
def load(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def public_path(name: str) -> str:
    """The file of a public tokenizer that is installed with the Python environment."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def encoder(path: str, words: bool, chunks_kept: int = MAX_CHUNKS, words_kept: int = MAX_WORDS) -> Encoder:
    """One encoder for all tasks of a worker process."""
    return Encoder(path, words, chunks_kept, words_kept)


def ragged(flat: np.ndarray, lens: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``flat`` that ``index`` names, one after the other, and their lengths."""
    n = lens[index]
    if not len(index):
        return flat[:0], n
    shift = (np.cumsum(lens) - lens)[index] - (np.cumsum(n) - n)
    return flat[np.repeat(shift, n) + np.arange(int(n.sum()))], n


def _byte_letters() -> dict[int, str]:
    """The letter of each byte in byte-level tokenizers: printable ones stand for themselves, the others are counted on from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


_TABLE = _byte_letters()
LEAD = _TABLE[32]


def _letters(word: str) -> str:
    """A word in byte letters; ``LEAD`` and ``WALL`` are byte letters already."""
    if word[0] == LEAD:
        return LEAD + word[1:].encode().decode("latin-1").translate(_TABLE)
    return word if word == WALL else word.encode().decode("latin-1").translate(_TABLE)


def _simple(chunk: str, lead: str, words: list[str]) -> bool:
    """Split letters and the ASCII marks behind them, and the same again after a line feed. False if it is something else."""
    if chunk.isalpha():
        words.append(lead + chunk)
        return True
    stem = chunk.rstrip(punctuation)
    if stem != chunk and (not stem or stem.isalpha()):
        if stem:
            words.append(lead + stem)
            lead = ""
        words.append(lead + chunk[len(stem):])
        return True
    if "\n" in chunk:
        a, b = chunk.split("\n", 1)
        if _simple(a, lead, words):
            words.append(WALL)
            return _simple(b, "", words)
    return False


class Numbers(dict):
    """A key that is new gets the next number."""

    def __missing__(self, key) -> int:
        n = self[key] = len(self)
        return n


class Memory:
    """Runs of ids by key; new keys are given to ``learn`` (keys -> ids, lengths). When it is full, the keys asked for most often stay."""

    def __init__(self, learn):
        self.learn, self.known = learn, Numbers()
        self.flat, self.lens, self.uses = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def keep(self, n: int) -> None:
        """Forget all but the ``n`` keys asked for most often, of equal ones the newest. Older uses count half from now on."""
        stay = np.sort(np.argsort(self.uses, kind="stable")[max(0, len(self.uses) - n):])
        keys = list(self.known)
        self.known = Numbers(zip([keys[i] for i in stay.tolist()], range(len(stay))))
        self.flat, self.lens = ragged(self.flat, self.lens, stay)
        self.uses = self.uses[stay] >> 1

    def numbers(self, keys: list[str]) -> np.ndarray:
        known = self.known
        n = len(known)
        found = np.fromiter(map(known.__getitem__, keys), np.int64, len(keys))
        if len(known) > n:
            flat, lens = self.learn(list(islice(known, n, None)))
            self.flat, self.lens = np.concatenate([self.flat, flat]), np.concatenate([self.lens, lens])
            self.uses = np.concatenate([self.uses, np.zeros(len(lens), np.int32)])
        self.uses[found] += 1
        return found


class Encoder:
    """``ids(texts)`` gives all ids of an Arrow array of texts as one array, and the number of ids of each text.

    ``words``: the tokenizer drops white space, so chunks are what lies between spaces and line feeds; otherwise a chunk
    keeps the space before it.
    """

    def __init__(self, path: str, words: bool, chunks_kept: int = MAX_CHUNKS, words_kept: int = MAX_WORDS):
        self.words, self.tokenizer = words, load(path)
        self.chunks_kept, self.words_kept = chunks_kept, words_kept
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.lower = words and self.tokenizer.normalizer.normalize_str("A") == "a"
        self.bare, self.spelled = _bare(path)
        self.memory, self.word_memory = Memory(self._chunks), Memory(self.encode_words)

    # from words to ids

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of normalised, split words and their number: all words go to the library in one text.

        A token spells the letters that it stands for, so a word ends where all letters up to its end are spelled.
        """
        ids = np.asarray(self.bare.encode_batch_fast([" ".join(words)])[0].ids, np.uint32)
        upto = np.cumsum(self.spelled[ids])
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        if len(ids) and upto[-1] == ends[-1]:
            last = np.searchsorted(upto, ends)
            if (upto[last] == ends).all():
                return ids, np.diff(last, prepend=-1)
        return _runs([e.ids for e in self.bare.encode_batch_fast(words)])  # letters that the vocabulary lacks

    # from chunks to words

    def _split(self, texts: list[str]) -> list[list[str]]:
        """The words of each text, as the tokenizer's own normaliser and splitter give them."""
        normal = self.tokenizer.normalizer.normalize_str if self.tokenizer.normalizer else str
        pre = self.tokenizer.pre_tokenizer.pre_tokenize_str
        return [[w for w, _ in pre(normal(t))] for t in texts]

    def _normal(self, chunks: list[str]) -> list[str]:
        """Normalised chunks; those without inner white space go to the normaliser as one text."""
        if not self.tokenizer.normalizer:
            return chunks
        joined = " ".join(chunks)
        # up to here lower case is the normal form
        plain = self.lower and not _BEYOND.search(joined)
        parts = (joined.lower() if plain else self.tokenizer.normalizer.normalize_str(joined)).split(" ")
        if len(parts) != len(chunks):
            raise ValueError("the normaliser made or dropped a space")
        return parts

    def _chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks. Letters with marks behind them are split here, anything else by the library."""
        lead = "" if self.words else LEAD
        blank = {i for i, c in enumerate(chunks) if not c or _BLANK.search(c)} if self.words else set()
        forms = self._normal(["x" if i in blank else c for i, c in enumerate(chunks)] if blank else chunks)
        held = pa.array(forms, pa.string())
        easy = pc.and_(pc.utf8_is_alpha(held), pc.string_is_ascii(held)).to_numpy(zero_copy_only=False)
        easy[list(blank)] = False
        words = list(compress(forms, easy))
        flat, lens = self._of_words([lead + w for w in words] if lead else words, np.ones(len(words), np.int64))
        if len(words) == len(chunks):
            return flat, lens
        hard = np.flatnonzero(~easy).tolist()
        return _weave(~easy, flat, lens, *self._hard([forms[i] for i in hard], [chunks[i] for i in hard], [i in blank for i in hard]))

    def _hard(self, forms: list[str], chunks: list[str], blank: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks that aren't ASCII letters alone."""
        words, n, odd = [], [], {}
        for i, (c, out) in enumerate(zip(forms, blank)):
            k = len(words)
            head = "" if self.words else LEAD
            if not self.words and c[:1] == HEAD:
                c, head = c[1:], ""
            if out or (not c.isascii() and (LEAD in c or WALL in c)) or not _simple(c, head, words):
                del words[k:]
                odd[i] = chunks[i] if self.words else c if not head else f" {c}"
            n.append(len(words) - k)
        flat, lens = self._of_words([w if w.isascii() else _letters(w) for w in words], np.array(n, np.int64))
        if not odd:
            return flat, lens
        rest = self._split(list(odd.values()))
        own, sizes = self._of_words([w for ws in rest for w in ws], np.fromiter(map(len, rest), np.int64, len(rest)))
        mask = np.zeros(len(chunks), bool)
        mask[list(odd)] = True
        return _weave(mask, flat, lens[~mask], own, sizes)

    def _of_words(self, words: list[str], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        index = self.word_memory.numbers(words)
        flat, lens = ragged(self.word_memory.flat, self.word_memory.lens, index)
        edge, upto = np.concatenate([[0], np.cumsum(lens)]), np.concatenate([[0], np.cumsum(n)])
        return flat, edge[upto[1:]] - edge[upto[:-1]]

    # from texts to chunks

    def _whole(self, texts: pa.Array) -> np.ndarray:
        odd = pc.match_substring(texts, HEAD)
        for s in self.specials:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        if not self.words:
            odd = pc.or_(odd, pc.match_substring_regex(texts, IRREGULAR))
        return odd.to_numpy(zero_copy_only=False)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "")
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        whole = self._whole(texts)
        plain = pc.if_else(pa.array(whole), "", texts) if whole.any() else texts
        # fewer distinct chunks: a mark behind a word becomes a chunk of its own
        if self.words:
            plain = pc.replace_substring_regex(plain, r"(\pL)([.,;:!?])([ \n])", r"\1 \2 ")
            plain = pc.replace_substring(plain, "\n", " ")
            latin = pc.invert(pc.match_substring_regex(plain, r"[^\x{00}-\x{12f}]"))  # there, normal form is lower case
            plain = pc.if_else(latin, pc.utf8_lower(plain), plain) if self.lower else plain
        else:
            plain = pc.replace_substring_regex(plain, r"(\pL)([.,;:!?]) ", rf"\1 {HEAD}\2 ")
            plain = pc.replace_substring_regex(plain, r"(\pL)([.,;:!?])\n(\pL)", f"\\1 {HEAD}\\2 {HEAD}\n {HEAD}\\3")
            plain = pc.binary_join_element_wise(HEAD, plain, "")
        split = pc.split_pattern(plain, " ")
        counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        chunks = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        index = self.memory.numbers(chunks)[coded.indices.to_numpy()]
        flat, lens = ragged(self.memory.flat, self.memory.lens, index)
        for memory, most in ((self.memory, self.chunks_kept), (self.word_memory, self.words_kept)):
            if len(memory.known) > most:
                memory.keep(most // 2)
        edge = np.concatenate([[0], np.cumsum(lens)])
        upto = np.concatenate([[0], np.cumsum(counts)])
        n_ids = edge[upto[1:]] - edge[upto[:-1]]
        if not whole.any():
            return flat, n_ids
        own = self.encode_whole(texts.take(pa.array(np.flatnonzero(whole))).to_pylist())
        return _weave(whole, flat, n_ids[~whole], *_runs(own))  # those encoded whole have no ids so far

    def encode_whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _bare(path: str):
    """The tokenizer's model alone, which splits at spaces, and the number of letters that each id spells (0: not known)."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    spec |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": [], "post_processor": None}
    model = spec["model"]
    spelled = np.zeros(max(model["vocab"].values()) + 1, np.int64)
    if not model.get("continuing_subword_prefix") and not model.get("byte_fallback"):
        for token, i in model["vocab"].items():
            spelled[i] = 0 if token == model.get("unk_token") else len(token.removesuffix(model.get("end_of_word_suffix") or "") or token)
    return Tokenizer.from_str(json.dumps(spec)), spelled


def _weave(own: np.ndarray, flat: np.ndarray, lens: np.ndarray, flat2: np.ndarray, lens2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs put together again: the places in ``own`` take the runs of ``flat2`` in order, the others those of ``flat``."""
    sizes = np.zeros(len(own), np.int64)
    sizes[~own], sizes[own] = lens, lens2
    out = np.empty(int(sizes.sum()), np.uint32)
    mine = np.repeat(own, sizes)
    out[~mine], out[mine] = flat, flat2
    return out, sizes


def _runs(each: list) -> tuple[np.ndarray, np.ndarray]:
    lens = np.fromiter(map(len, each), np.int64, len(each))
    return (np.concatenate([np.asarray(x, np.uint32) for x in each]) if each else np.zeros(0, np.uint32)), lens
