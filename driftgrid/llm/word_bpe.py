"""BPE encoding by a trie over distinct words, and decoding."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgrid.llm.common import chunks
from driftgrid.llm.tokens import LATIN, MEMO, byte_letters

END = "</w>"

class TrieCoder:
    """Encodes sets of distinct words by depth-first traversal of their trie.

    The state of a trie node is the last token of its prefix's encoding. The encoding of a prefix is that of
    a shorter prefix plus one token; among the tokens that end the prefix, the right one is that which
    BPE leaves apart from the shorter prefix's last token. Words come in sorted order, so the stack
    holds the path of the trie and a prefix shared by many words is encoded once. The last letter of
    a word carries the word-end mark and so is a leaf of its own.
    """

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))["model"]
        self.ids: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merge, self.made = {}, {}
        rank = {}
        for r, (a, b) in enumerate(pairs):
            a_, b_, t = self.ids[a], self.ids[b], self.ids[a + b]
            self.merge[a_, b_] = r
            rank.setdefault(t, r)
            self.made.setdefault(t, (a_, b_))
        self.rank = rank
        self.names = {i: t for t, i in self.ids.items()}
        self.longest = max(len(t.removesuffix(END)) for t in self.ids)
        self.apart: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}

    def keeps_apart(self, a: int, b: int) -> bool:
        """Whether BPE leaves tokens a and b side by side: no merge across the seam comes first at any time.

        Goes back in time: undoes the later of the two merges next to the seam, then asks whether the two
        tokens at the seam would have been merged before it. At equal rank the left one comes first.
        """
        known = self.apart.get((a, b))
        if known is not None:
            return known
        x, y, limit = a, b, len(self.merge)
        while True:
            r = self.merge.get((x, y))
            if r is not None and r < limit:
                result = False
                break
            rx, ry = self.rank.get(x, -1), self.rank.get(y, -1)
            if rx < 0 and ry < 0:
                result = True
                break
            if rx > ry:
                limit, x = rx, self.made[x][1]
            else:
                limit, y = ry + 1, self.made[y][0]
        self.apart[a, b] = result
        return result

    def whole(self, t: int) -> bool:
        """Whether the token's own text is encoded as this token."""
        known = self.alone.get(t)
        if known is None:
            name = self.names[t]
            body, mark = (name[:-len(END)], END) if name.endswith(END) else (name, "")
            parts = [self.ids[c] for c in body[:-1]] + [self.ids[body[-1] + mark]]
            while len(parts) > 1:
                r, i = min((self.merge.get((parts[i], parts[i + 1]), 1 << 60), i) for i in range(len(parts) - 1))
                if r == 1 << 60:
                    break
                parts[i:i + 2] = [self.ids[self.names[parts[i]] + self.names[parts[i + 1]]]]
            known = self.alone[t] = parts == [t]
        return known

    def encode(self, words: list[str]) -> Iterator[tuple[str, tuple[int, ...]]]:
        """(word, ids) for words in byte letters without repeats; sorted here.

        A node keeps its last token and the length of the prefix before it, so memory grows with the word's
        length; the ids are read off backwards.
        """
        ids, longest, path = self.ids, self.longest, ""
        last, start = [-1], [0]            # of the prefix of each length on the path

        def ending(word: str, n: int, mark: str) -> tuple[int, int]:
            for size in range(min(n, longest), 0, -1):
                t = ids.get(word[n - size:n] + mark)
                if t is None or not self.whole(t):
                    continue
                if size == n or self.keeps_apart(last[n - size], t):
                    return t, n - size
            raise ValueError(f"no token ends {word[max(0, n - longest):n]!r}")

        for word in sorted(words):
            stem, shared = word[:-1], 0
            top = min(len(stem), len(path))
            while shared < top and stem[shared] == path[shared]:
                shared += 1
            del last[shared + 1:], start[shared + 1:]
            for n in range(shared + 1, len(stem) + 1):
                t, before = ending(stem, n, "")
                last.append(t)
                start.append(before)
            path = stem
            t, n = ending(word, len(word), END)
            out = [t]
            while n:
                out.append(last[n])
                n = start[n]
            yield word, tuple(out[::-1])


class WordTokens:
    """Texts to tokens: words by pattern, distinct new words through the trie, a bounded memo of words."""

    OTHER = re.compile(f"[^\t\n\r\x20-\x7e{LATIN}]|<\\|(?:start|end)oftext\\|>")
    WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LATIN}]+|[0-9]|[^\\s{LATIN}0-9]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library, self.coder = Tokenizer.from_file(path), TrieCoder(path)
        self.special = [(i, t.content) for i, t in self.library.get_added_tokens_decoder().items()]
        self.letters = {b: c for b, c in byte_letters().items()}
        self.memo: dict[str, tuple[int, str, str]] = {}

    def _letters(self, word: str) -> str:
        return word if word.isascii() else "".join([self.letters[b] for b in word.encode()])

    def _split(self, text: str) -> list[str]:
        """Words of a text in byte letters; special tokens stand as themselves."""
        if not self.OTHER.search(text):
            return [self._letters(w) for w in self.WORD.findall(text.lower())]
        out, names = [], [c for _, c in self.special]
        for part in re.split("(" + "|".join(map(re.escape, names)) + ")", text) if names else [text]:
            if part in names:
                out.append(part)
            elif part:
                normal = self.library.normalizer.normalize_str(part)
                out += [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        return out

    def learn(self, words: set[str]) -> None:
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
            for i, name in self.special:
                memo[name] = (1, str(i), name)
        names = self.coder.names
        for word, ids in self.coder.encode([w for w in words if w not in memo]):
            memo[word] = (len(ids), " ".join(map(str, ids)), " ".join([names[i] for i in ids]))

    def encode(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """(number of tokens, decimal ids joined by a space, decoded text) of each text."""
        split = [self._split(t) for t in texts]
        for i, name in self.special:
            self.memo.setdefault(name, (1, str(i), name))
        self.learn({w for words in split for w in words})
        memo = self.memo
        for words in split:
            found = [memo[w] for w in words]
            yield sum([f[0] for f in found]), " ".join([f[1] for f in found]), " ".join([f[2] for f in found])


def encode_decode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """key, n_tokens, ids (decimal, joined by spaces), decoded for every row; with digest their sha256 instead.

    Null and empty texts have no tokens. Every task inserts the distinct words of a batch that it has not
    met into a trie and reads all their encodings off one traversal; nothing is shuffled. Rows are
    independent: repeats give repeats.
    """
    def run(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = WordTokens(vocabulary)
        for texts in frames:
            out = []
            for f in chunks(iter([pd.DataFrame({"text": texts})]), "text"):
                for n, ids, plain in coder.encode([t if isinstance(t, str) else "" for t in f["text"]]):
                    out.append((n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(plain.encode()).hexdigest()) if digest else (n, ids, plain))
            yield pd.DataFrame(out, columns=["n", "ids", "decoded"])

    udf = F.pandas_udf(run, "n long, ids string, decoded string")
    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn("c", udf("text"))
    tail = "_sha256" if digest else ""
    return out.select(F.col("key").alias(key), F.col("c.n").alias("n_tokens"), F.col("c.ids").alias(f"ids{tail}"), F.col("c.decoded").alias(f"decoded{tail}"))
