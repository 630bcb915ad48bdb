"""Token ids of whole texts by a public tokenizer file, with a cache of chunks.

Both tokenizer files split a text before any merge, and no split crosses the chunk borders
used here, so a text's ids are its chunks' ids in a row. As in a plain call of the library, an added token of the file
that is met in a text, such as an end mark, is a chunk of its own and has its reserved id. Chunks repeat; each distinct one goes
through the tokenizers library once per worker while the bounded cache holds it; one that
is a single word to the tokenizer goes straight to the library's merge model.
Ids travel as little-endian unsigned 32-bit bytes.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import islice
from struct import pack

from quillspark.llm import caches

#: The code points with the Unicode property White_Space.
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Latin letters that stay one letter in lower case and under normalisation.
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
_WORD = f"[{_LATIN}]++(?![^\\x00-\\x7f])"
#: Chunks of a byte-level tokenizer keep their white space ...
BYTE_CHUNKS = f" ?{_WORD}| ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
#: ... a word tokenizer drops it, so ASCII white space alone is enough to cut at.
WORD_CHUNKS = f"{_WORD}|[^\t-\r ]+"

CACHE_LIMIT = 900_000


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else one from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in printable}
    for n, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + n)
    return table


class ChunkEncoder(dict):
    """The id bytes of chunks. A new chunk goes through the library; the chunks met first stay in the cache."""

    def __init__(self, path: str, chunks: str, limit: int = CACHE_LIMIT) -> None:
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError("an added token of this file is not matched as it stands")
        self.added = [t.content for t in added]
        self.marks = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))).finditer
        self.model = self.tokenizer.model
        self.split = re.compile(chunks).findall
        self.lower = chunks == WORD_CHUNKS
        self.word = re.compile(f" ?[{_LATIN}]+" if not self.lower else f"[{_LATIN}]+").fullmatch
        self.letters = _byte_letters()
        self.space = self.letters[32]
        self.limit = limit

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.limit:
            kept = dict(islice(self.items(), self.limit // 2))
            self.clear()
            self.update(kept)
        rest = chunk[1:]
        if chunk.isascii() and rest.isalpha() and (chunk[0] == " " or chunk[0].isalpha()):  # the usual word
            ids = [t.id for t in self.model.tokenize(chunk.lower() if self.lower else self.space + rest if chunk[0] == " " else chunk)]
        elif self.word(chunk):  # one word before the merges: the model alone will do
            word = chunk.lower() if self.lower else chunk
            word = word.replace(" ", self.space) if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            ids = [t.id for t in self.model.tokenize(word)]
        else:
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        value = self[chunk] = pack(f"<{len(ids)}I", *ids)
        return value

    def encode(self, text: str) -> tuple[list[str], list[bytes]]:
        if not any(t in text for t in self.added):
            chunks = self.split(text)
        else:
            chunks, at = [], 0
            for m in self.marks(text):
                chunks += [*self.split(text[at : m.start()]), m[0]]
                at = m.end()
            chunks += self.split(text[at:])
        return chunks, list(map(self.__getitem__, chunks))


@lru_cache(maxsize=1)
def _encoder(path: str, chunks: str) -> ChunkEncoder:
    return ChunkEncoder(path, chunks)


def encoder(path: str, chunks: str) -> ChunkEncoder:
    """One encoder, and so one cache, for each worker process."""
    caches.claim("tokens")
    return _encoder(path, chunks)


caches.register("tokens", _encoder.cache_clear)

