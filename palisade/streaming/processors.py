"""Stateful steps of the streaming jobs: one processor per job, state in the state store's maps and lists, dropped by event-time timers.

A call gets the rows of one key in one micro-batch; they are kept as narrow tuples (no texts), in the order of turns. What must be known of earlier
batches is in the state and is bounded: 30 context entries, the distinct values sent in a session, one flag. A key without rows for its idle time
loses its state when the watermark passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

WINDOW_MS, KEEP = 900_000, 30
IDLE_MS = 86_400_000


def _present(value) -> bool:
    return value is not None and value == value


class Expiring(StatefulProcessor):
    """Keeps one timer per key, `idle_ms` after the latest row."""

    idle_ms = IDLE_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ends = handle.getValueState("ends", "at long")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def forget(self) -> None:
        raise NotImplementedError

    def rest_until(self, latest_ms: int, watermark_ms: int) -> None:
        at = max(latest_ms + self.idle_ms, watermark_ms + 1)
        old = self.ends.get()[0] if self.ends.exists() else None
        if old is not None and old >= at:
            return
        if old is not None:
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)
        self.ends.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.forget()
        self.ends.clear()
        return iter([])

    def close(self) -> None:
        pass


class Context(Expiring):
    """conv_id, turn, ts_ms, direction, clusters (joined text), payout -> the message with its inbound context.

    A row without direction only adds clusters to the message of its turn.
    """

    idle_ms = WINDOW_MS
    OUT = "conv_id long, turn long, ts_ms long, direction string, ctx array<struct<turn:long,ts_ms:long,clusters:array<string>,payout:boolean>>"

    def open(self, handle) -> None:
        self.held = handle.getListState("held", "turn long, ts_ms long, clusters string, payout boolean")

    def forget(self) -> None:
        self.held.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found: dict[int, list] = {}
        for pdf in rows:
            for turn, ts, direction, clusters, payout in zip(pdf["turn"], pdf["ts_ms"], pdf["direction"], pdf["clusters"], pdf["payout"], strict=True):
                m = found.setdefault(int(turn), [None, None, set(), False])
                m[2].update(c for c in clusters.split(",") if c)
                if _present(direction):
                    m[:2], m[3] = [int(ts), direction], bool(payout)
        held = [(int(t), int(ts), c, bool(p)) for t, ts, c, p in self.held.get()]
        out = []
        for turn in sorted(found):
            ts, direction, clusters, payout = found[turn]
            if direction is None:
                continue
            if direction == "inbound":
                held = [*held, (turn, ts, ",".join(sorted(clusters)), payout)][-KEEP:]
            ctx = [{"turn": t, "ts_ms": at, "clusters": c.split(",") if c else [], "payout": p} for t, at, c, p in held if 0 <= ts - at < WINDOW_MS]
            out.append((key[0], turn, ts, direction, ctx))
        self.held.put(held) if held else self.held.clear()
        if out:
            self.rest_until(max(r[2] for r in out), timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame(out, columns=["conv_id", "turn", "ts_ms", "direction", "ctx"])


class Outbound(Expiring):
    """conv_id, turn, ts_ms, session, cards, cvv, lone, expiry, otp, gps, sab, item_id -> what was sent before and with each message.

    State: the distinct cards, codes, dates, one-time codes and watch-list items sent in the session. Another session starts afresh. A row without
    session only adds an item to the message of its turn.
    """

    KINDS = ("card", "cvv", "exp", "otp", "item")
    OUT = (
        "conv_id long, turn long, session long, card_now boolean, cvv_now boolean, exp_now boolean, otp_now boolean, gps boolean, sab boolean, n_items int, "
        "card_before boolean, exp_before boolean, cvv_before boolean, items_before boolean, n_cards int, n_cvvs int, n_expiries int, n_otps int, n_labels int"
    )

    def open(self, handle) -> None:
        self.sent = handle.getMapState("sent", "kind string, value string", "turn long")
        self.session = handle.getValueState("session", "number long")

    def forget(self) -> None:
        self.sent.clear()
        self.session.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found: dict[int, dict] = {}
        latest = 0
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                m = found.setdefault(int(r.turn), {"items": set(), "row": None})
                if _present(r.item_id):
                    m["items"].add(str(int(r.item_id)))
                if _present(r.session):
                    m["row"] = r
                    latest = max(latest, int(r.ts_ms))
        session = int(self.session.get()[0]) if self.session.exists() else None
        seen: dict[str, set] = {k: set() for k in self.KINDS}
        for (kind, value), _ in self.sent.iterator():
            seen[kind].add(value)
        out = []
        for turn in sorted(found):
            r = found[turn]["row"]
            if r is None:
                continue
            if session != int(r.session):
                self.sent.clear()
                seen = {k: set() for k in self.KINDS}
                session = int(r.session)
                self.session.update((session,))
            cards = set(r.cards) if r.cards is not None else set()
            cvv = r.cvv if _present(r.cvv) else r.lone if _present(r.lone) and (cards or seen["card"]) else None
            now = {"card": cards, "cvv": {cvv} - {None}, "exp": {r.expiry} if _present(r.expiry) else set(), "otp": {r.otp} if _present(r.otp) else set(), "item": found[turn]["items"]}
            before = {k: bool(v) for k, v in seen.items()}
            for kind, values in now.items():
                for value in sorted(values - seen[kind]):
                    self.sent.updateValue((kind, value), (turn,))
                seen[kind] |= values
            out.append((
                key[0], turn, session, bool(now["card"]), bool(now["cvv"]), bool(now["exp"]), bool(now["otp"]), bool(r.gps), bool(r.sab), len(now["item"]),
                before["card"], before["exp"], before["cvv"], before["item"], *[len(seen[k]) for k in self.KINDS],
            ))
        if out:
            self.rest_until(latest, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame(out, columns=[c.split()[0] for c in self.OUT.split(", ")])


class Quarantine(Expiring):
    """conv_id, turn, ts_ms, is_scam, confidence -> the verdict as it stands. State: one flag."""

    OUT = "conv_id long, turn long, quarantined boolean, is_scam boolean, confidence double"

    def open(self, handle) -> None:
        self.on = handle.getValueState("on", "on boolean")

    def forget(self) -> None:
        self.on.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found, latest = [], 0
        for pdf in rows:
            found += zip(pdf["turn"], pdf["is_scam"], pdf["confidence"], strict=True)
            latest = max(latest, int(pdf["ts_ms"].max())) if len(pdf) else latest
        on = bool(self.on.get()[0]) if self.on.exists() else False
        out = []
        for turn, scam, conf in sorted(found, key=lambda r: r[0]):
            scam = _present(scam) and bool(scam)
            out.append((key[0], int(turn), on, on or scam, 99.0 if on else conf))
            on = on or (scam and _present(conf) and conf >= 75)
        self.on.update((on,))
        self.rest_until(latest, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame(out, columns=["conv_id", "turn", "quarantined", "is_scam", "confidence"])
