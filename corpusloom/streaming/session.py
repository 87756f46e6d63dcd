"""Chat sessions over a stream of messages: state per conversation, trimmed to what a window holds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.streaming import ingest

RESET, LEAVE = "/reset", ("/exit", "/quit")
OUT = "conv_id bigint, n_messages bigint, n_kept bigint, n_prompt bigint"


def messages(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, role, content) of a stream of conversations; the messages of one arrive together, in order."""
    said = conversations.where("messages is not null").select("conv_id", "received_at", F.posexplode("messages").alias("at", "m"))
    return said.where("m.role in ('user', 'assistant')").select("conv_id", F.unix_micros("received_at").alias("received"), "at", F.col("m.role").alias("role"), F.coalesce("m.content", F.lit("")).alias("content"))


def cost(role: str, content: str) -> int:
    return len(content.encode()) + len(role) + 4


def trimmed(history: list[int], block: int, reserve: int) -> list[int]:
    """Costs of the turns kept: the oldest two go until prompt, its header of twelve and the reserve fit or one is left."""
    while len(history) > 1 and sum(history) + 12 + reserve > block:
        history = history[2:]
    return history


def session(block: int, reserve: int):
    """What becomes of one conversation's new messages. The state is the costs of its kept turns, bounded by the window,
    and the first delivery's time, since a conversation that is delivered again adds nothing."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, first, kept = state.get if state.exists else (0, None, [])
        kept, open_ = list(kept), True
        new = pd.concat(list(frames)).sort_values(["received", "at"])
        first = int(new["received"].min()) if first is None else first
        for row in new[new["received"] == first].drop_duplicates("at").itertuples():
            if not open_ or row.role == "user" and row.content in LEAVE:
                open_ = False
                continue
            if row.role == "user" and row.content == RESET:
                kept = []
                continue
            seen, kept = seen + 1, trimmed([*kept, cost(row.role, row.content)], block, reserve)
        state.update((seen, first, kept))
        yield pd.DataFrame({"conv_id": [key[0]], "n_messages": [seen], "n_kept": [len(kept)], "n_prompt": [sum(kept) + 12]})

    return run


def turns_kept(said: DataFrame, block: int, reserve: int) -> DataFrame:
    """(conv_id, n_messages, n_kept, n_prompt) of every session after what has come so far."""
    kept = said.groupBy("conv_id").applyInPandasWithState(session(block, reserve), OUT, "seen bigint, first bigint, kept array<bigint>", "append", GroupStateTimeout.NoTimeout)
    return ingest.once_to_files(kept)
