"""Chat formatting by black-box rendering of successive turn prefixes.

A template is anything with render(turns) -> str.  The operator never looks
inside it: it renders turn prefixes one by one and compares consecutive
outputs.  What the longer output adds is the new turn's span.  Rendering the
same prefix with the last text left empty shows where inside the span the text
stands.  An output that doesn't start with its predecessor means the template
rewrites history, and is reported as such.

Every prefix is rendered whole, from the first turn on, since a template may
look at any of them.  So a conversation is held in memory and rendering it
takes time that grows with the square of its length.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class MarkedTemplate:
    """<s>, then for each turn <|turn|>role, a line end, the text, <|end|> and a line end.

    Inside roles and texts a backslash is doubled and each control string gets
    one after its first character, so it no longer occurs; dropping the first
    of each pair of backslash and character undoes both.  A line end in a role
    gets a backslash before it.
    """

    # Strings with a meaning in this and in common other templates.
    control = ("<s>", "</s>", "[INST]", "[/INST]", "<|turn|>", "<|end|>")
    opening, turn, end = "<s>", "<|turn|>", "<|end|>\n"

    def escape(self, text: str) -> str:
        text = text.replace("\\", "\\\\")
        for c in self.control:
            text = text.replace(c, f"{c[0]}\\{c[1:]}")
        return text

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text

    def render(self, turns: list[tuple[str, str]]) -> str:
        return self.opening + "".join(f"{self.turn}{self._role(role)}\n{self.escape(text)}{self.end}" for role, text in turns)

    def _role(self, role: str) -> str:
        return self.escape(role).replace("\n", "\\\n")

    def parse(self, piece: str) -> tuple[str, str]:
        """Role and text of one rendered turn."""
        piece = piece.removeprefix(self.opening)
        header = re.match(r"<\|turn\|>((?:[^\\\n]|\\.)*+)\n", piece, re.S)
        return self.unescape(header[1]), self.unescape(piece[header.end() : len(piece) - len(self.end)])


class PrefixRenderer:
    """Feeds turns to a template one at a time and locates each turn's span and text."""

    def __init__(self, template):
        self.template, self.turns, self.before, self.at = template, [], "", 0

    def add(self, role: str, text: str) -> dict:
        t = self.template
        self.turns.append((role, text))
        now = t.render(self.turns)
        steady = now.startswith(self.before)
        piece = now[len(self.before) :] if steady else now[_common(now, self.before) :]
        bare = t.render([*self.turns[:-1], (role, "")])
        at, size = _inside(piece, bare[len(now) - len(piece) :], text, t)
        out = {"piece": piece, "start": self.at, "end": self.at + len(piece), "text_start": self.at + at, "text_end": self.at + at + size, "rewrites": not steady}
        self.before, self.at = now, self.at + len(piece)
        return out


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    lo, hi = 0, n
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    return lo


def _inside(piece: str, bare: str, text: str, template) -> tuple[int, int]:
    """Where the text stands in its span: what the span has beyond the span of an empty text; (0, 0) if it's altered."""
    size = len(piece) - len(bare)
    if size <= 0:
        return 0, 0
    p = _common(piece, bare)
    # the boundary may be anywhere up to p when the text begins as the footer does
    for at in range(p, -1, -1):
        if piece[at + size :] != bare[at:]:
            break
        if template.unescape(piece[at : at + size]) == text:
            return at, size
    return 0, 0


OUT = "conv_id long, seq long, role string, piece string, start long, end long, text_start long, text_end long, loss boolean, rewrites boolean"


def format_conversations(rows: DataFrame, template=None, train_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per turn, in order within a partition: the formatted piece, its span, its text's span, whether that is trained on.

    The pieces of a conversation, joined in order, are its formatted text;
    offsets are code points into that.  Null texts and roles count as empty, null conv_ids
    form one conversation, null turns come first, and rows with the same
    conv_id and turn follow by role and text.  Further columns are ignored, texts are formatted whole, however long, and
    an empty table gives an empty table.
    """
    template = template or MarkedTemplate()
    ordered = (
        rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )

    def render(batches):
        import pandas as pd

        conv, renderer, seq = (), None, 0
        for batch in batches:
            out = []
            ids = [None if pd.isna(x) else int(x) for x in batch["conv_id"]]
            for c, role, text in zip(ids, batch["role"], batch["text"], strict=True):
                if (c,) != conv:
                    conv, renderer, seq = (c,), PrefixRenderer(template), 0
                r = renderer.add(role, text)
                out.append((c, seq, role, r["piece"], r["start"], r["end"], r["text_start"], r["text_end"], role in train_roles, r["rewrites"]))
                seq += 1
            frame = pd.DataFrame(out, columns=[x.split()[0] for x in OUT.split(", ")])
            frame["conv_id"] = frame["conv_id"].astype("Int64")
            yield frame

    return ordered.mapInPandas(render, OUT)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites long"


def conversation_digests(formatted: DataFrame, template=None) -> DataFrame:
    """Per conversation, read back from the formatted pieces: counts and digests of turns and of the text under the loss mask.

    `formatted` is format_conversations() as it comes: grouped and in order
    within partitions, so this is one more streaming pass and no shuffle.
    """
    template = template or MarkedTemplate()

    def digest(batches):
        import pandas as pd

        conv, state, done = (), None, []

        def close():
            if state:
                done.append((conv[0], state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["all"], state["rewrites"]))

        def frame():
            out = pd.DataFrame(done, columns=[x.split()[0] for x in DIGEST.split(", ")])
            out["conv_id"] = out["conv_id"].astype("Int64")
            done.clear()
            return out

        for batch in batches:
            ids = [None if pd.isna(x) else int(x) for x in batch["conv_id"]]
            cols = (batch[c] for c in ("piece", "start", "text_start", "text_end", "loss", "rewrites"))
            for c, piece, start, a, b, loss, rewrites in zip(ids, *cols, strict=True):
                if (c,) != conv:
                    close()
                    conv, state = (c,), {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0, "all": 0, "rewrites": 0}
                role, text = template.parse(piece)
                state["n"] += 1
                state["turns"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                state["all"] += len(piece)
                state["rewrites"] += bool(rewrites)
                if loss:
                    masked = template.unescape(piece[a - start : b - start])
                    state["chars"] += len(masked)
                    state["loss"].update(masked.encode("utf-8", "surrogatepass"))
            if done:
                yield frame()
        close()
        if done:
            yield frame()

    return formatted.mapInPandas(digest, DIGEST)
