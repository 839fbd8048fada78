"""Subword ids of whole texts, by a public tokenizer, with a per-process cache of words."""

from __future__ import annotations

import codecs
import os
import re
import sys
import types
import unicodedata


def process_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker, so later tasks in it find what earlier ones put there."""
    holder = sys.modules.setdefault("lodestar_worker_cache", types.ModuleType("lodestar_worker_cache"))
    return holder.__dict__.setdefault(name, {})


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def words_of(text: str) -> list[bytes]:
    """The words of a text: runs without ASCII white space, A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "replace").lower().split()


class ByteWords:
    """Ids by UTF-8 word for a tokenizer whose pieces never cross white space and that ignores ASCII case (the word BPE).

    A text's ids are those of its words (``words_of``) in order, so a word is encoded once and then looked up in a cache
    that the process keeps. New words are encoded together, as one text in which a mark stands between every two. A run of
    letters, with signs before or behind it or not, is the tokenizer's own unit: where its normalisation leaves the word as it is,
    the letters skip it and the signs are looked up. The cache is emptied when it would grow beyond `most` words.
    """

    #: One piece of one id, wherever it stands between spaces; words that hold it are encoded singly.
    MARK, PLAIN_MARK = "\x01", "!"
    #: Of each line signs, letters, signs, or the line as it is. (Signs are neither letters, numbers nor white space.)
    LETTERS = re.compile(r"^(?:((?:[^\w\s]|_)*)([^\W\d_]+)((?:[^\w\s]|_)*)|(.+))$", re.M)
    #: How the byte-level alphabet writes each byte: those that are not printable characters come from 256 on. A space stays one.
    HIDDEN = [c for c in range(256) if not (33 <= c <= 126 or 161 <= c <= 172 or 174 <= c <= 255)]
    SHOWN = "".join(map(chr, range(256))).translate({c: 256 + i for i, c in enumerate(HIDDEN) if c != 32})

    def __init__(self, path: str, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer, pre_tokenizers

        cache = process_cache(f"tokenizer {path}")
        if "tokenizer" not in cache:
            cache["tokenizer"], cache["words"] = Tokenizer.from_file(path), {}
            cache["plain"] = Tokenizer(cache["tokenizer"].model)
            cache["plain"].pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.check(cache["tokenizer"])
            added = [t.content for t in cache["tokenizer"].get_added_tokens_decoder().values()]
            cache["special"] = re.compile("|".join(map(re.escape, added))) if added else None
            suffix = getattr(cache["tokenizer"].model, "end_of_word_suffix", None)
            pieces = cache["tokenizer"].get_vocab()
            cache["closing"] = np.zeros(max(pieces.values()) + 1, bool)
            cache["closing"][[i for p, i in pieces.items() if suffix and p.endswith(suffix)]] = True
        self.tokenizer, self.plain, self.known, self.most = cache["tokenizer"], cache["plain"], cache["words"], most
        self.closing, self.special = cache["closing"], cache["special"]
        self.ends = {c: self.one(self.tokenizer, [c.decode()], self.MARK)[0] for c in (b".", b",")} | {b"": b""}

    @staticmethod
    def check(tokenizer) -> None:
        """Raises where the tokenizer does not give a text the ids of its lower-case words, one after another."""
        words = ["Ab", "it's", "ÉÀ,b.", "x1y", "AB漢字", "<b>"]
        ids = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
        apart = [i for w in words for i in ids(w.encode().lower().decode())]
        if any(ids(gap.join(words)) != apart for gap in (" ", "\n", "\t  ")):
            raise ValueError("this tokenizer looks across white space or at the case of letters")

    def closed(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of plain letters. Each ends in a piece that closes a word, so they need no marks between them."""
        import numpy as np

        shown = codecs.charmap_decode(b" ".join(words), "strict", self.SHOWN)[0]
        ids = np.array(self.plain.encode_batch_fast([shown], add_special_tokens=False)[0].ids, "<u4")
        stops = np.flatnonzero(self.closing[ids]) + 1
        if len(stops) != len(words):
            return self.one(self.plain, shown.split(" "), self.PLAIN_MARK)
        data, at = ids.tobytes(), (4 * stops).tolist()
        return [data[a:b] for a, b in zip([0, *at], at, strict=False)]

    @staticmethod
    def one(tokenizer, words: list[str], mark: str) -> list[bytes]:
        """Little-endian 32-bit ids of each word, from one call."""
        import numpy as np

        whole = tokenizer.encode_batch_fast([f" {mark} ".join(["", *words])], add_special_tokens=False)[0]
        ids = np.array(whole.ids, "<u4")
        starts = np.flatnonzero(ids == ids[0]) + 1
        if len(starts) != len(words):  # some word holds the mark
            return [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        data = ids.tobytes()
        return [data[4 * a : 4 * b] for a, b in zip(starts.tolist(), [*(starts[1:] - 1).tolist(), len(ids)], strict=True)]

    def encode(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of each word, and of the letters in it where they are looked up apart."""
        # (signed words and their parts are held in four lists: many small tuples would keep the garbage collector busy)
        alone, others, mixed, signed, fronts, cores, backs = [], [], [], [], [], [], []
        for w in words:
            if w.isalpha():  # of bytes: ASCII letters alone
                alone.append(w)
            elif w[-1:] in self.ends and w[:-1].isalpha():
                signed.append(w)
                fronts.append(b"")
                cores.append(w[:-1])
                backs.append(w[-1:])
            else:
                mixed.append(w)
        text = b"\n".join(mixed).decode("utf-8", "replace")
        unchanged = lambda t: t.isascii() or (t.lower() == t and unicodedata.is_normalized("NFC", t))
        all_unchanged, special = unchanged(text), self.special.search if self.special and self.special.search(text) else None
        for w, (before, core, after, _) in zip(mixed, self.LETTERS.findall(text), strict=True):
            # an apostrophe right before letters may begin a contraction; a word that normalisation changes is left to the tokenizer
            if not core or before == "'" or not core.isalpha() or (special and special(before + core + after)) or not (all_unchanged or w.isascii() or unchanged(before + core + after)):
                others.append(w)
            else:
                signed.append(w)
                fronts.append(before.encode())
                cores.append(core.encode())
                backs.append(after.encode())
        out = dict(zip(others, self.one(self.tokenizer, [w.decode("utf-8", "replace") for w in others], self.MARK), strict=True)) if others else {}
        known, ends = self.known, self.ends
        need = [c for c in dict.fromkeys([*alone, *cores]) if c not in known]
        if need:
            out.update(zip(need, self.closed(need), strict=True))
        if signed:
            if signs := [x for x in {*fronts, *backs} if x not in ends]:
                ends = ends | dict(zip(signs, self.one(self.tokenizer, [x.decode() for x in signs], self.MARK), strict=True))
            ids = [ends[a] + (out[c] if c in out else known[c]) + ends[b] for a, c, b in zip(fronts, cores, backs, strict=True)]
            out.update(zip(signed, ids, strict=True))
        return out

    def ids(self, words: list[bytes]) -> list[bytes]:
        try:
            return list(map(self.known.__getitem__, words))
        except KeyError:
            self.learn(words)
            return list(map(self.known.__getitem__, words))

    def learn(self, words: list[bytes]) -> None:
        """Makes sure that the cache has all the words."""
        missing = [w for w in set(words) if w not in self.known]
        if len(self.known) + len(missing) > self.most:
            self.known.clear()
            missing = list(set(words))
        if missing:
            self.known.update(self.encode(missing))

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts, as the tokenizer itself gives them."""
        split = [words_of(t) for t in texts]
        self.learn([w for words in split for w in words])
        return [b"".join(map(self.known.__getitem__, words)) for words in split]


def groups_of(texts: list[str], most_chars: int = 2_000_000):
    """(from, to) ranges of consecutive texts with about so many characters in all."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most_chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
