"""Vector bin packing of token sequences, by the dot-product heuristic, block by block.

An example has three demands: tokens, one segment, and loss-bearing tokens (the last ``loss`` of its
tokens, as in a prompt with its answer). A sequence holds at most ``max_tokens``, ``max_segments`` and
``max_loss`` of them. For the sequence at hand the heuristic takes the example that fits and whose demands
have the largest dot product with what is left, so scarce room goes to those that need it. When none fits,
one is cut so that the sequence becomes full. What a block leaves over in a sequence that isn't full is
dealt over sequences of powers of two, so padding is left to none.

Blocks are runs of rows of one input partition: nothing is shuffled, a lost task repeats by itself, and
memory is that of a block, however large the table.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table, trim

END_ID = 2
CACHED_WORDS = 1_200_000
BLOCK_ROWS, BLOCK_BYTES = 2048, 32 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Ids of texts, as the tokenizer gives for each whole text, found by word.

    The tokenizer drops white space and never merges across it, so the ids of a text are those of its
    blank-separated words in turn; it lowers case, and parts letters from a mark after them. Words met before are
    looked up; new ones are encoded many at a time, between marks that no other word holds.
    """

    MARK = "\x01"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        self.mark = self._ids([self.MARK])[0]
        whole, *parts = self._ids([" Some  WORDS, don't\n\tmerge. (Ünder) x=1! ", "some", "words,", "don't", "merge.", "(ünder)", "x=1!"])
        stop, letters, mark = self._ids(["merge.", "merge", "."])
        if whole != b"".join(parts) or stop != letters + mark:
            raise ValueError(f"{path}: ids of a text must be those of its lower-case, blank-separated words")

    def _ids(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        # special tokens are matched in their own case, so a text that may hold one keeps its case
        split = [t.split() if b"<|" in t else t.lower().split() for t in texts]
        words = set(chain.from_iterable(split))
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > CACHED_WORDS:
            self.known.clear()
            new = list(words)
        # letters before one mark: the ids of the letters, then those of the mark
        ends = {w: w[:-1] for w in new if w[-1:] in b".,;:!?" and w[:-1].isalpha()}
        self._learn([w for w in {*(w for w in new if w not in ends), *ends.values(), *(w[-1:] for w in ends)} if w not in self.known])
        for w, letters in ends.items():
            self.known[w] = self.known[letters] + self.known[w[-1:]]
        return [b"".join(map(self.known.__getitem__, ws)) for ws in split]

    def _learn(self, words: list[bytes], at_once=400) -> None:
        mark, sep = np.frombuffer(self.mark, "<u4"), f" {self.MARK} "
        odd = [w for w in words if self.MARK.encode() in w or b"<|" in w] if len(mark) == 1 else words
        if odd:
            self.known.update(zip(odd, self._ids([w.decode() for w in odd]), strict=True))
            words = [w for w in words if w not in self.known]
        runs = [words[i : i + at_once] for i in range(0, len(words), at_once)]
        for run, e in zip(runs, self.tokenizer.encode_batch_fast([sep.join(w.decode() for w in r) for r in runs], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            cuts = [-1, *np.flatnonzero(ids == mark[0]).tolist(), len(ids)]
            if len(cuts) != len(run) + 1:
                raise RuntimeError("a word without the mark gave its id")
            data = ids.tobytes()
            self.known.update((w, data[4 * a + 4 : 4 * b]) for w, a, b in zip(run, cuts, cuts[1:], strict=False))


@lru_cache(2)
def _encoder(path: str) -> WordIds:
    return WordIds(path)


def pack_block(tokens, loss, max_tokens=4096, max_segments=64, max_loss=4096) -> list[list[tuple[int, int, int]]]:
    """Sequences of (example, start, length) pieces; each token of each example is in one of them."""
    n = np.asarray(tokens, dtype=np.int64)
    first_loss = n - np.minimum(np.asarray(loss, dtype=np.int64), n)
    start, live = np.zeros_like(n), n > 0
    out: list[list[tuple[int, int, int]]] = []

    def loss_of(i, s, length) -> int:
        return int(max(0, s + length - max(s, first_loss[i])))

    def longest(i, s, room, loss_room) -> int:
        """Tokens of the longest piece from s on that keeps both limits."""
        return int(min(n[i] - s, room, max(0, first_loss[i] - s) + loss_room))

    for i in np.flatnonzero((n >= max_tokens) | (n - first_loss > max_loss)):
        while (length := longest(i, start[i], max_tokens, max_loss)) and (length == max_tokens or n[i] - start[i] > length):
            if length < max_tokens:  # the loss limit cuts it: this piece shares its sequence no more
                out += _by_powers([(int(i), int(start[i]), length)], length)
            else:
                out.append([(int(i), int(start[i]), length)])
            start[i] += length
        live[i] = start[i] < n[i]
    t, ls = (n - start).astype(float), (n - np.maximum(start, first_loss)).astype(float)
    # demands as shares of the limits, weighted by how scarce each limit is in this block
    share = [max(1e-9, t[live].sum() / max_tokens), max(1e-9, live.sum() / max_segments), max(1e-9, ls[live].sum() / max_loss)]
    a = np.array(share) / sum(share)
    left = int(live.sum())
    while left:
        room, seats, loss_room, pieces = max_tokens, max_segments, max_loss, []
        while room and seats and left:
            score = t * (a[0] * room / max_tokens**2) + (a[1] * seats / max_segments**2) + ls * (a[2] * loss_room / max_loss**2)
            i = int(np.argmax(np.where(live & (t <= room) & (ls <= loss_room), score, -1.0)))
            if live[i] and t[i] <= room and ls[i] <= loss_room:
                length, live[i], left = int(t[i]), False, left - 1
            else:  # none fits whole: one is cut
                i = int(np.argmax(np.where(live, t - ls + np.minimum(ls, loss_room), -1.0)))
                if not (length := longest(i, start[i], room, loss_room)):
                    break
            pieces.append((i, int(start[i]), length))
            used = loss_of(i, int(start[i]), length)
            room, seats, loss_room = room - length, seats - 1, loss_room - used
            start[i] += length
            t[i], ls[i] = t[i] - length, ls[i] - used
        out += [pieces] if not room else _by_powers(pieces, max_tokens - room)
    return out


def _by_powers(pieces: list[tuple[int, int, int]], total: int) -> list[list[tuple[int, int, int]]]:
    """The same tokens in sequences whose lengths are the powers of two that add up to total."""
    out, queue = [], list(reversed(pieces))
    for k in reversed(range(total.bit_length())):
        need, now = total & (1 << k), []
        while need:
            i, s, length = queue.pop()
            now.append((i, s, min(length, need)))
            if length > need:
                queue.append((i, s + need, length - need))
            need -= now[-1][2]
        out += [now] if now else []
    return out


def pack_documents(
    docs: DataFrame, tokenizer: str | None = None, max_tokens=4096, max_segments=64, max_loss: int | None = None, with_ids=False, keep_words=True, id_col="doc_id", text_col="text", prompt_col: str | None = None,
) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens (and ids).

    With ``prompt_col``, for instruction data, an example is its prompt and then its text, whose tokens and end id alone bear loss, and a
    sequence holds at most ``max_loss`` of these (by default half of ``max_tokens``). Without it all tokens bear loss, so only ``max_tokens``
    limits them unless ``max_loss`` is given. A null text or prompt is empty, and an empty example is the end id alone;
    repeated rows are packed each for itself; an empty table gives no rows. Ids are integers. sequence_id holds the input
    partition in its upper bits. keep_words: whether a Python worker keeps the words that it has met (CACHED_WORDS at most, some
    250 MB) for its next task, which spares a third of the time. The tokenizer must give a text the ids of its words; others are refused.
    """
    path = tokenizer or default_tokenizer()
    most = max_loss or (max_tokens // 2 if prompt_col else max_tokens)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]
    schema = pa.schema([(x, pa.int64()) for x in names] + [("ids", pa.list_(pa.int32()))] * with_ids)

    def packed(batches):
        encoder, task, made = _encoder(path), TaskContext.get().partitionId(), 0
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for ids, texts, prompts in _blocks(batch):
                answers = [x + end for x in encoder.encode(texts)]
                coded = [p + a for p, a in zip(encoder.encode(prompts), answers, strict=True)] if prompt_col else answers
                lengths, loss = (np.array([len(x) // 4 for x in c]) for c in (coded, answers))
                rows, pieces_ids = [], []
                for seq in pack_block(lengths, loss, max_tokens, max_segments, most):
                    at = 0
                    for i, s, length in seq:
                        own = coded[i][4 * s : 4 * (s + length)]
                        bears = max(0, s + length - max(s, int(lengths[i] - loss[i])))
                        rows.append((ids[i], s, length, zlib.crc32(own), int(lengths[i]), (task << 40) + made, at, bears))
                        pieces_ids.append(np.frombuffer(own, "<i4")) if with_ids else None
                        at += length
                    made += 1
                columns = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(pieces_ids, pa.list_(pa.int32()))] * with_ids, schema=schema)
        if not keep_words:
            encoder.known.clear()
            trim()

    ddl = ", ".join(f"{x} long" for x in names) + ", ids array<int>" * with_ids
    prompt = [f"`{prompt_col}` prompt"] if prompt_col else []
    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text", *prompt).mapInArrow(packed, ddl)


def instruction_examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> (conv_id, turn, prompt, text): every turn of the assistant, and as its prompt the turn before it. Turns are
    matched by equality, so that no conversation is one task's; without a turn before, the prompt is null."""
    before = conversations.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prompt"))
    return conversations.where("role = 'assistant'").join(before, ["conv_id", "turn"], "left").select("conv_id", "turn", "prompt", "text")


def _blocks(batch: pa.RecordBatch):
    """(ids, texts, prompts as bytes) of runs of rows, BLOCK_ROWS and about BLOCK_BYTES at most."""
    ids, texts, prompts, size = [], [], [], 0
    others = batch.column(2).cast(pa.binary()) if batch.num_columns > 2 else [None] * batch.num_rows
    for i, text, prompt in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), others, strict=True):
        text, prompt = text.as_py() or b"", (prompt.as_py() or b"") if prompt is not None else b""
        ids.append(i)
        texts.append(text)
        prompts.append(prompt)
        size += len(text) + len(prompt)
        if len(ids) == BLOCK_ROWS or size >= BLOCK_BYTES:
            yield ids, texts, prompts
            ids, texts, prompts, size = [], [], [], 0
    if ids:
        yield ids, texts, prompts


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
