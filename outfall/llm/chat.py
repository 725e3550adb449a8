"""Chat formatting by token-level assembly (operator 9).

Turns are escaped and encoded one by one where they are read; the segments then meet once, sorted inside their
conversation, and a streaming pass splices reserved ids between them. Token spans and the loss mask are prefix sums of
segment lengths. A conversation of any length passes through in chunks; nothing of it is held but a running state.

Template (reserved ids stand for the marks; they can't come from a text, whose bytes are encoded as ordinary tokens):
user ``[INST]text[/INST]``, system ``[SYS]text[/SYS]``, assistant ``<s>text</s>``, other roles ``[ROLE]role[/ROLE]text[END]``.
In the written form of the output, a mark that occurs inside a text gets a backslash after its first character, and one
that already has backslashes there gets one more, so reading removes exactly one.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outfall.llm.common import pieces, ship

#: The marks of the template.
MARKS = ("[INST]", "[/INST]", "[SYS]", "[/SYS]", "<s>", "</s>", "[ROLE]", "[/ROLE]", "[END]")
TURNS = {"user": ("[INST]", "[/INST]"), "system": ("[SYS]", "[/SYS]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE]", "[/ROLE]", "[END]")
#: Fixed value: the word pattern of the byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Tokens in one row of the output.
CHUNK = 65_536

#: White space in a row from which a text is cut; the class is that of the word pattern, which is not Python's.
LONG_SPACE = 100_000
_LONG_SPACE = re.compile(rf"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{LONG_SPACE},}}")

_RAW = re.compile("|".join(re.escape(m[0]) + r"(\\*)" + re.escape(m[1:]) for m in MARKS))
_OUT = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("last", pa.bool_()), ("input_ids", pa.list_(pa.int32())),
                  ("loss_mask", pa.list_(pa.int8())), ("text", pa.string())])


def escape(text: str) -> str:
    return _RAW.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text) if "[" in text or "<" in text else text


def unescape(text: str) -> str:
    return _RAW.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text) if "\\" in text else text


@lru_cache(maxsize=2)
def _encoding(raw: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
    return tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1


def encode(encoding, text: str) -> list[int]:
    """The encoding's own ids of a text of any shape.

    Its word pattern gives up, and the process with it, on about a million white-space characters in a row. Such a run is one word up to its last
    place, which may belong to the next word, so the text is cut there and the run is merged without the pattern.
    """
    ids, at = [], 0
    for run in _LONG_SPACE.finditer(text) if len(text) >= LONG_SPACE else ():
        end = run.end() - (run.end() < len(text))
        ids += encoding.encode_ordinary(text[at:run.start()]) + encoding._encode_single_piece(text[run.start():end])
        at = end
    return ids + encoding.encode_ordinary(text[at:])


def _segments(raw: bytes, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each turn's own tokens: an escaped role (empty for the known ones) and an escaped text."""
    encoding, _ = _encoding(raw)
    for batch in pieces(batches, "text"):
        roles = [escape(r) if r not in TURNS else "" for r in batch.column("role").to_pylist()]
        texts = [escape(t) for t in batch.column("text").to_pylist()]
        ids = [encode(encoding, t) for t in texts]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "turn", "role")), pa.array(texts, pa.string()),
                                          pa.array([encode(encoding, r) for r in roles], pa.list_(pa.int32())), pa.array(ids, pa.list_(pa.int32()))],
                                         names=["conv_id", "turn", "role", "written", "role_ids", "ids"])


def _assemble(first_mark: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Splice marks between the sorted segments; rows of at most about CHUNK tokens, in order."""
    mark = {m: first_mark + i for i, m in enumerate(MARKS)}
    now: object = _assemble  # no conversation yet
    segments: list[tuple[np.ndarray, bool]] = []
    texts: list[str] = []
    held = chunk = 0

    def row(last: bool) -> tuple:
        sizes = np.array([len(s) for s, _ in segments], np.int64)
        ends = np.cumsum(sizes)
        change = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.int8)
        learned = np.array([m for _, m in segments], bool)
        np.add.at(change, (ends - sizes)[learned], 1)
        np.add.at(change, ends[learned], -1)
        return now, chunk, last, np.concatenate([s for s, _ in segments]) if segments else np.zeros(0, np.int32), np.cumsum(change, dtype=np.int8)[:-1], "".join(texts)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _OUT.field(i).type) for i in range(len(_OUT))], schema=_OUT)

    out: list[tuple] = []
    for batch in batches:
        conv, role, written = (batch.column(c).to_pylist() for c in ("conv_id", "role", "written"))
        lists = {}
        for name in ("role_ids", "ids"):
            column = batch.column(name)
            lists[name] = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
        for i in range(batch.num_rows):
            if conv[i] != now or now is _assemble:
                if now is not _assemble:
                    out.append(row(True))
                now, segments, texts, held, chunk = conv[i], [], [], 0, 0
            ids = lists["ids"][1][lists["ids"][0][i]:lists["ids"][0][i + 1]]
            if role[i] in TURNS:
                before, after = TURNS[role[i]]
                segments += [(np.array([mark[before]], np.int32), False)]
                texts.append(before)
            else:
                name = lists["role_ids"][1][lists["role_ids"][0][i]:lists["role_ids"][0][i + 1]]
                segments += [(np.array([mark[OTHER[0]]], np.int32), False), (name, False), (np.array([mark[OTHER[1]]], np.int32), False)]
                texts += [OTHER[0], escape(role[i]), OTHER[1]]
                after = OTHER[2]
            segments += [(ids, role[i] == "assistant"), (np.array([mark[after]], np.int32), False)]
            texts += [written[i], after]
            held += len(ids)
            if held >= CHUNK:
                out.append(row(False))
                segments, texts, held, chunk = [], [], 0, chunk + 1
        if sum(len(r[3]) for r in out) >= CHUNK:
            yield batch_of(out)
            out = []
    if now is not _assemble:
        out.append(row(True))
    if out:
        yield batch_of(out)


def format_conversations(turns: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Training rows (conv_id, chunk, last, input_ids, loss_mask, text) of turns (conv_id, turn, role, text).

    Turns are ordered by turn, then role and text, so equal turn numbers have one result; a repeated row is a turn said twice.
    Null role or text: empty. A null conv_id is a conversation of its own; a null turn comes first. Loss falls on the texts of assistants.
    Rows of one conversation are in one partition and in order. Other columns are left out. No turns: no rows.
    """
    raw = ship(turns.sparkSession, vocabulary)
    _, first_mark = _encoding(raw)
    clean = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                         F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    shared = turns.sparkSession.sparkContext.broadcast(raw)  # of a size that ship() has checked
    encoded = clean.mapInArrow(lambda batches: _segments(shared.value, batches),
                               "conv_id long, turn long, role string, written string, role_ids array<int>, ids array<int>")
    return encoded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "written") \
        .mapInArrow(lambda batches: _assemble(first_mark, batches), "conv_id long, chunk long, last boolean, input_ids array<int>, loss_mask array<tinyint>, text string")


_READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
                   ("n_tokens", pa.int64()), ("n_loss_tokens", pa.int64()), ("same_text", pa.bool_())])


def _read_back(raw: bytes, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns and loss text as a reader finds them in the ids and masks; chunks of a conversation follow each other."""
    encoding, first_mark = _encoding(raw)
    of_pair = {pair: role for role, pair in TURNS.items()}
    state = None
    for batch in batches:
        rows = []
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "chunk", "last", "text")]
        ids_at, ids_all = batch.column("input_ids").offsets.to_numpy(), batch.column("input_ids").values.to_numpy(zero_copy_only=False)
        mask_all = batch.column("loss_mask").values.to_numpy(zero_copy_only=False)
        for i, (conv, chunk, last, text) in enumerate(zip(*columns, strict=True)):
            if not chunk:
                state = {"turns": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "tokens": 0, "learned": 0, "same": True}
            ids, mask = ids_all[ids_at[i]:ids_at[i + 1]], mask_all[ids_at[i]:ids_at[i + 1]]
            at = np.flatnonzero(ids >= first_mark)
            written, opened, role = [], None, None
            for j, place in enumerate(at):
                mark = MARKS[ids[place] - first_mark]
                between = encoding.decode(ids[at[j - 1] + 1:place].tolist()) if j else ""
                written += [between, mark]
                if mark in ("[INST]", "[SYS]", "<s>", "[ROLE]"):
                    opened = mark
                elif mark == "[/ROLE]":
                    role = unescape(between)
                else:
                    said, by = unescape(between), of_pair.get((opened, mark), role)
                    state["turns"] += 1
                    state["all"].update(f"{by}\n{said}\n".encode())
                    under = mask[at[j - 1] + 1:place]
                    if under.any():
                        learned = unescape(encoding.decode(ids[at[j - 1] + 1:place][under == 1].tolist()))
                        state["loss"].update(learned.encode())
                        state["loss_chars"] += len(learned)
            state["same"] &= "".join(written) == text
            state["chars"] += len(text)
            state["tokens"] += len(ids)
            state["learned"] += int(mask.sum())
            if last:
                rows.append((conv, state["turns"], state["all"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"], state["tokens"], state["learned"], state["same"]))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _READ.field(i).type) for i in range(len(_READ))], schema=_READ)


def read_back(formatted: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per conversation with digests of what its token ids and loss mask say; same_text: the ids decode to ``text``."""
    shared = formatted.sparkSession.sparkContext.broadcast(ship(formatted.sparkSession, vocabulary))
    return formatted.mapInArrow(lambda batches: _read_back(shared.value, batches),
                                "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long, same_text boolean")


def chat_digest(conversations: DataFrame) -> DataFrame:
    """All conversations and number -1, whose two texts consist of marks."""
    said = "</s>[INST] ok [/INST]"
    extra: Column = F.explode(F.array(*(F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(said).alias("text")) for i, role in enumerate(("user", "assistant")))))
    added = conversations.sparkSession.range(1).select(extra.alias("x")).select("x.*")
    return read_back(format_conversations(conversations.select("conv_id", "turn", "role", "text").union(added)))
