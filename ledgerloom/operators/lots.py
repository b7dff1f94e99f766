"""Investments: tax lots (DOM29-DOM34), prices and holdings (DOM35-DOM37), FX (DOM38-DOM41)."""

from __future__ import annotations

import hashlib
from datetime import date
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache
from heapq import heappop, heappush, heapreplace
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import sha16

CENT = Decimal("0.01")
#: Corporate actions first, then what adds, then what takes away.
DAY_ORDER = {"split": 0, "return_of_capital": 0, "sell": 2, "transfer_out": 2}
SOURCE_RANK = ("override", "plaid", "tiingo", "coingecko", "trade_implied")
SCHEMA = """kind string, id string, account_id long, security_id long, event_id long, lot_id string, acquired date, disposed date,
quantity decimal(28,10), remaining decimal(28,10), basis decimal(18,2), remaining_basis decimal(18,2), proceeds decimal(18,2), gain decimal(18,2), term string, incomplete boolean, method string"""


def elected_method(security: Column, account: Column, security_type: Column) -> Column:
    """DOM29: the security's method, else the account's (average only for funds), else fifo."""
    fund = security_type.isin("mutual_fund", "etf")
    return F.coalesce(security, F.when((account != "average") | fund, account), F.lit("fifo"))


def _cents(x: Decimal) -> Decimal:
    return x.quantize(CENT, ROUND_HALF_UP)


def _sha(prefix: str, *parts) -> str:
    return prefix + hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:16]


def _anniversary(d: date) -> date:
    return date(d.year + 1, 2, 28) if (d.month, d.day) == (2, 29) else date(d.year + 1, d.month, d.day)


def spread(total: Decimal, parts: list[Decimal]) -> list[Decimal]:
    """DOM31: shares of total by parts, in cents; the last takes what is left."""
    whole = sum(parts, Decimal(0))
    out = [_cents(total * p / whole) for p in parts[:-1]]
    return [*out, total - sum(out, Decimal(0))] if parts else []


class Book:
    """Open lots of one account and security, replayed event by event."""

    def __init__(self, method: str, picks: dict):
        self.method, self.picks = method, picks
        self.lots: list[dict] = []
        self.gains: list[dict] = []
        self.units, self.cost = Decimal(0), Decimal(0)

    def open(self) -> list[dict]:
        return [x for x in self.lots if x["left"] > 0]

    def add(self, e) -> None:
        q = abs(e.quantity or Decimal(0))
        if q <= 0:
            return
        basis = _cents(abs(e.amount or Decimal(0)))
        self.lots.append({"id": _sha("lot_", e.account_id, e.security_id, e.event_id), "event": e.event_id, "day": e.date, "q": q, "left": q, "basis": basis, "left_basis": basis})
        self.units += q
        self.cost += basis

    def split(self, m) -> None:
        if m is not None:
            for x in self.open():
                x["q"] *= m
                x["left"] *= m
            self.units *= m

    def give_back(self, amount: Decimal) -> None:
        """DOM32: by quantity over the open lots, none below zero; what the last can't take is lost."""
        if self.method == "average":
            self.cost -= min(amount, self.cost)
            return
        lots = self.open()
        if not lots:
            return
        whole, target = sum(x["left"] for x in lots), min(amount, sum(x["left_basis"] for x in lots))
        done = Decimal(0)
        for x in lots[:-1]:
            part = min(_cents(target * x["left"] / whole), x["left_basis"])
            x["left_basis"] -= part
            done += part
        lots[-1]["left_basis"] -= min(target - done, lots[-1]["left_basis"])

    def _plan(self, event_id) -> list[tuple[dict, Decimal]]:
        lots = sorted(self.open(), key=lambda x: (x["day"], x["id"]))
        if self.method == "hifo":
            lots.sort(key=lambda x: (-(x["left_basis"] / x["left"]), x["day"], x["id"]))
        plan = [(x, x["left"]) for x in lots]
        if self.method == "specific":
            by = {x["id"]: x for x in self.lots}
            plan = [(by[i], q) for i, q in self.picks.get(event_id, []) if i in by and by[i]["left"] > 0] + plan
        return plan

    def take(self, e) -> None:
        need = total = abs(e.quantity or Decimal(0))
        if total <= 0:
            return
        each = self.cost / self.units if self.units > 0 else Decimal(0)
        parts: dict[str, dict] = {}
        for lot, most in self._plan(e.event_id):
            q = min(need, most, lot["left"])
            if q <= 0:
                continue
            basis = lot["left_basis"] if q == lot["left"] else _cents(lot["left_basis"] * q / lot["left"])
            lot["left"] -= q
            lot["left_basis"] -= basis
            part = parts.setdefault(lot["id"], {"lot": lot["id"], "day": lot["day"], "q": Decimal(0), "basis": Decimal(0), "open": False})
            part["q"] += q
            part["basis"] += basis
            need -= q
            if need <= 0:
                break
        slices = list(parts.values())
        if self.method == "average" and slices:
            matched = sum(x["q"] for x in slices)
            pooled = self.cost if matched == self.units else min(self.cost, _cents(matched * each))
            for x, b in zip(slices, spread(pooled, [x["q"] for x in slices]), strict=True):
                x["basis"] = b
            self.units -= matched
            self.cost -= pooled
        if e.type != "sell":
            return
        if need > 0:
            slices.append({"lot": "unmatched", "day": e.date, "q": need, "basis": Decimal(0), "open": True})
        for x, p in zip(slices, spread(_cents(abs(e.amount or Decimal(0))), [x["q"] for x in slices]), strict=True):
            self.gains.append({"id": _sha("rg_", e.event_id, x["lot"]), "event": e.event_id, "lot": x["lot"], "acquired": x["day"], "disposed": e.date, "q": x["q"], "basis": x["basis"], "proceeds": p, "gain": p - x["basis"], "term": "long" if e.date > _anniversary(x["day"]) else "short", "open": x["open"]})

    def settle(self) -> None:
        """DOM33: under average cost the open lots share what the pool holds."""
        if self.method != "average":
            return
        lots = self.open()
        for x in self.lots:
            if x["left"] <= 0:
                x["left_basis"] = Decimal(0)
        if lots:
            each, done = self.cost / self.units, Decimal(0)
            for x in lots[:-1]:
                x["left_basis"] = _cents(x["left"] * each)
                done += x["left_basis"]
            lots[-1]["left_basis"] = _cents(self.cost - done)


def _integers(column: pa.Array) -> list:
    """Unscaled values of decimals of up to 38 digits, nulls as None."""
    if not len(column):
        return []
    low, high = np.frombuffer(column.buffers()[1], np.int64)[2 * column.offset :][: 2 * len(column)].reshape(-1, 2).T
    if ((low >> 63) == high).all():
        out = low.tolist()
    else:
        out = [(h << 64) + (x & 0xFFFFFFFFFFFFFFFF) for x, h in zip(low.tolist(), high.tolist(), strict=True)]
    if column.null_count:
        out = [x if ok else None for x, ok in zip(out, column.is_valid().to_pylist(), strict=True)]
    return out


def _decimals(values: list, digits: int, scale: int) -> pa.Array:
    """The other way round."""
    try:
        plain = pa.array(values, pa.int64())
        none = plain.is_null() if plain.null_count else None
        low = (plain.fill_null(0) if plain.null_count else plain).to_numpy()
        high = low >> 63
    except (OverflowError, pa.ArrowInvalid):
        none = pa.array([v is None for v in values])
        whole = [v or 0 for v in values]
        low = np.array([v & 0xFFFFFFFFFFFFFFFF for v in whole], np.uint64).view(np.int64)
        high = np.array([v >> 64 for v in whole], np.int64)
    bits = None if none is None else pa.py_buffer(np.packbits(~none.to_numpy(zero_copy_only=False), bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.decimal128(digits, scale), len(values), [bits, pa.py_buffer(np.stack([low, high], 1).tobytes())])


def _list(column: pa.Array) -> list:
    """What to_pylist gives, without an object of Arrow's for each value."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        coded = column.dictionary_encode()
        names = [*coded.dictionary.to_pylist(), None]
        return [names[i] for i in coded.indices.fill_null(len(names) - 1).to_numpy().tolist()]
    return column.to_pylist() if column.null_count else column.to_numpy().tolist()


#: Up to here the integer walk and Decimal's 28 digits round alike.
PLAIN = 10**13
TEN = 10**10
EPOCH = date(1970, 1, 1).toordinal()


class _Tie:
    """Lots of one day are taken by their id; it is made only where two of them meet."""

    __slots__ = ("parts",)

    def __init__(self, *parts):
        self.parts = parts

    def __lt__(self, other):
        return _sha("lot_", *self.parts) < _sha("lot_", *other.parts)


def _walk(method: str, events: list, emit) -> bool:
    """A group of purchases and sales in order, as ``Book`` walks it but in integers (cents, 1e-10 units);
    False where it holds anything else or larger values, which are Book's."""
    for _, _, _, kind, quantity, amount in events:
        if kind == "split" or kind == "return_of_capital" or (quantity or 0) > PLAIN * 100 or (quantity or 0) < -PLAIN * 100 or (amount or 0) > PLAIN or (amount or 0) < -PLAIN:
            return False
    account, security = events[0][0], events[0][1]
    lots, left, heap, gains, tied = [], [], [], [], False
    average, hifo = method == "average", method == "hifo"
    units = cost = 0
    for _, _, (event, day), kind, quantity, amount in events:
        quantity = abs(quantity or 0)
        if not quantity:
            continue
        amount = abs(amount or 0)
        if kind == "buy" or kind == "transfer_in" or kind == "reinvest":
            lot = [event, day, quantity, quantity, amount, amount]
            tied = tied or bool(lots) and lots[-1][1] == day
            lots.append(lot)
            if hifo:
                heappush(heap, (-(Decimal(amount) / Decimal(quantity)), day, _Tie(account, security, event), lot))
            else:
                left.append(lot)
            units += quantity
            cost += amount
        elif kind == "sell" or kind == "transfer_out":
            need, slices, k = quantity, [], 0
            if tied and not hifo:
                left.sort(key=lambda x: (x[1], _sha("lot_", account, security, x[0])))
            tied = False
            each = Decimal(cost).scaleb(-2) / Decimal(units).scaleb(-10) if average and units > 0 else None
            while need and (heap if hifo else k < len(left)):
                lot = heap[0][3] if hifo else left[k]
                rest = lot[3]
                q = need if need < rest else rest
                basis = lot[5] if q == rest else (2 * lot[5] * q + rest) // (2 * rest)
                lot[3] = rest - q
                lot[5] -= basis
                slices.append([lot[0], lot[1], q, basis, False])
                need -= q
                if q == rest:
                    if hifo:
                        heappop(heap)
                    k += 1
                elif hifo:
                    heapreplace(heap, (-(Decimal(lot[5]) / Decimal(lot[3])), *heap[0][1:]))
            del left[:k]
            if average and slices:
                matched = quantity - need
                pooled = cost if matched == units else min(cost, int((Decimal(matched).scaleb(-10) * each).quantize(CENT, ROUND_HALF_UP).scaleb(2)))
                done = 0
                for x in slices[:-1]:
                    x[3] = (2 * pooled * x[2] + matched) // (2 * matched)
                    done += x[3]
                slices[-1][3] = pooled - done
                units -= matched
                cost -= pooled
            if kind == "transfer_out":
                continue
            if need:
                slices.append([None, day, need, 0, True])
            done, last = 0, len(slices) - 1
            for k, (lot, acquired, q, basis, unmatched) in enumerate(slices):
                proceeds = amount - done if k == last else (2 * amount * q + quantity) // (2 * quantity)
                done += proceeds
                gains.append(("gain", account, security, event, lot, acquired, day, q, None, basis, None, proceeds, proceeds - basis, day > _year_on(acquired), unmatched, method))
    if average:
        if left:
            each, done = Decimal(cost).scaleb(-2) / Decimal(units).scaleb(-10), 0
            for x in lots:
                x[5] = 0
            open_ = [x for x in lots if x[3]]
            for x in open_[:-1]:
                x[5] = int((Decimal(x[3]).scaleb(-10) * each).quantize(CENT, ROUND_HALF_UP).scaleb(2))
                done += x[5]
            open_[-1][5] = cost - done
        else:
            for x in lots:
                x[5] = 0
    for event, day, quantity, rest, basis, kept in lots:
        emit(("lot", account, security, event, event, day, None, quantity, rest, basis, kept, None, None, None, False, method))
    for g in gains:
        emit(g)
    return True


@lru_cache(1 << 16)
def _year_on(day: int) -> int:
    return _anniversary(date.fromordinal(day + EPOCH)).toordinal() - EPOCH


def _by_book(method: str, events: list, picks: dict, emit) -> None:
    book = Book(method, picks)
    account, security = events[0][0], events[0][1]
    for _, _, (event, day), kind, quantity, amount in events:
        e = SimpleNamespace(account_id=account, security_id=security, event_id=event, date=date.fromordinal(day + EPOCH), type=kind, quantity=None if quantity is None else Decimal(quantity).scaleb(-10), amount=None if amount is None else Decimal(amount).scaleb(-2))
        if kind in ("buy", "transfer_in", "reinvest"):
            book.add(e)
        elif kind in ("sell", "transfer_out"):
            book.take(e)
        elif kind == "split":
            book.split(e.quantity)
        elif kind == "return_of_capital":
            book.give_back(_cents(abs(e.amount or Decimal(0))))
    book.settle()
    ten = Decimal("0.0000000001")
    units, cents, days = lambda x: int(x.quantize(ten).scaleb(10)), lambda x: int(x.scaleb(2)), lambda x: x.toordinal() - EPOCH
    at = {x["id"]: x["event"] for x in book.lots}
    for x in book.lots:
        emit(("lot", account, security, x["event"], x["event"], days(x["day"]), None, units(x["q"]), units(x["left"]), cents(x["basis"]), cents(x["left_basis"]), None, None, None, False, method))
    for g in book.gains:
        emit(("gain", account, security, g["event"], at.get(g["lot"]), days(g["acquired"]), days(g["disposed"]), units(g["q"]), None, cents(g["basis"]), None, cents(g["proceeds"]), cents(g["gain"]), g["term"] == "long", g["open"], method))


#: What the walk gives: ids are made of it after it.
WALKED = """kind string, account_id long, security_id long, event_id long, lot_event long, acquired date, disposed date, quantity decimal(28,10), remaining decimal(28,10),
basis decimal(18,2), remaining_basis decimal(18,2), proceeds decimal(18,2), gain decimal(18,2), long_term boolean, incomplete boolean, method string"""


#: Groups of more events are walked one by one.
WIDE = 512
BUY, SELL, OUT, OTHER = 1, 2, 3, 4
KINDS = {"buy": BUY, "transfer_in": BUY, "reinvest": BUY, "sell": SELL, "transfer_out": OUT, "split": OTHER, "return_of_capital": OTHER}


def _longs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unscaled values of decimals of up to 38 digits, nulls as 0, and which of them no long holds."""
    if not len(column):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    low, high = np.frombuffer(column.buffers()[1], np.int64)[2 * column.offset :][: 2 * len(column)].reshape(-1, 2).T
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    return np.where(valid, low, 0), valid & ((low >> 63) != high)


def _decimal_array(values: np.ndarray, digits: int, scale: int) -> pa.Array:
    return pa.Array.from_buffers(pa.decimal128(digits, scale), len(values), [None, pa.py_buffer(np.stack([values, values >> 63], 1).tobytes())])


def _half_up(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """a * b / c, half up; none is negative."""
    return (2 * a * b + c) // (2 * c)


class _Many:
    """Many groups of purchases and sales walked side by side, as ``_walk`` does each: the nth sale of all of them
    in one step, in integers.  ``bad`` are the groups that are left to ``_walk``: those that hold anything else, more
    events than ``WIDE``, products beyond 62 bits, lots of one day or, where the order
    hangs on the last digits of a ratio, lots of one price."""

    def __init__(self, start: np.ndarray, kind: np.ndarray, event: np.ndarray, day: np.ndarray, quantity: np.ndarray, amount: np.ndarray, method: np.ndarray, odd: np.ndarray):
        n = len(kind)
        self.event, self.day, self.amount = event, day, np.abs(amount)
        self.size = np.diff(start, append=n)
        self.group = np.repeat(np.arange(len(start)), self.size)
        self.method = method
        self.how = np.where(method == "average", 1, np.where(method == "hifo", 2, 0))
        quantity = np.abs(quantity)
        kind = np.where((quantity == 0) & (kind != OTHER), 0, kind)
        odd = odd | (kind == OTHER) | (quantity > PLAIN * 100) | (self.amount > PLAIN) | (quantity < 0) | (self.amount < 0)  # the least long has no absolute value
        self.bad = np.logical_or.reduceat(odd, start) | (self.size > WIDE) | (method == "specific")
        self.unit = np.maximum(np.gcd.reduceat(quantity, start), 1)
        self.quantity = quantity // self.unit[self.group]
        total = np.add.reduceat(self.quantity.astype(float), start) * np.maximum(np.add.reduceat(self.amount.astype(float), start), 1.0)
        self.bad |= total > 2.0**59
        self.kind = np.where(self.bad[self.group], 0, kind)

        self.row = np.flatnonzero(self.kind == BUY)
        own = self.group[self.row]
        same = (own[1:] == own[:-1]) & (day[self.row][1:] == day[self.row][:-1]) & (self.how[own[1:]] != 2)
        if same.any():
            self.bad[own[1:][same]] = True
            self.kind[self.bad[self.group]] = 0
            self.row = np.flatnonzero(self.kind == BUY)
        self.whole, self.cost = self.quantity[self.row], self.amount[self.row]
        self.left, self.basis = self.whole.copy(), self.cost.copy()
        self.upto = np.concatenate([[0], np.cumsum(self.kind == BUY)])  # lots before each row
        self.first = self.upto[start]
        self.units, self.costs = np.concatenate([[0], np.cumsum(self.whole)]), np.concatenate([[0], np.cumsum(self.cost)])
        self.slices: list[tuple] = []
        self.pooled = np.zeros(n, np.int64)

        sale = np.flatnonzero(self.kind > BUY)
        how, size = self.how[self.group[sale]], self.size[self.group[sale]]
        self.paid = np.zeros(len(start), np.int64)
        for one in range(3):
            for least, most in ((0, 16), (16, 48), (48, WIDE)):
                self._sales(sale[(how == one) & (size > least) & (size <= most)], one)
        self._settle()

    def _sales(self, sale: np.ndarray, how: int) -> None:
        """The sales of some groups, in rounds: each group's first, second and so on."""
        if not len(sale):
            return
        own = self.group[sale]
        new = np.concatenate([[True], own[1:] != own[:-1]])
        begin = np.flatnonzero(new)
        nth = np.arange(len(sale)) - np.repeat(begin, np.diff(begin, append=len(sale)))
        order = np.argsort(nth, kind="stable")
        head, matched, paid = self.first.copy(), np.zeros(len(self.size), np.int64), np.zeros(len(self.size), np.int64)
        for rows in np.split(sale[order], np.cumsum(np.bincount(nth))[:-1]):
            need, got = self.quantity[rows].copy(), self.group[rows]
            end = self.upto[rows]
            at = np.arange(len(rows))
            while True:
                if how == 2:
                    lot = self._dearest(got[at], end[at])
                    at, lot = at[lot >= 0], lot[lot >= 0]
                else:
                    at = at[head[got[at]] < end[at]]
                    lot = head[got[at]]
                if not len(at):
                    break
                rest, held = self.left[lot], self.basis[lot]
                q = np.minimum(need[at], rest)
                all_ = q == rest
                part = np.where(all_, held, _half_up(held, q, rest))
                self.left[lot] = rest - q
                self.basis[lot] = held - part
                need[at] -= q
                head[got[at][all_]] += 1
                self.slices.append((rows[at], lot, q, part))
                at = at[need[at] > 0]
            short = (need > 0) & (self.kind[rows] == SELL)
            if how == 1:
                took = self.quantity[rows] - need
                units = self.units[end] - self.units[self.first[got]] - matched[got]
                cost = self.costs[end] - self.costs[self.first[got]] - paid[got]
                pool = np.where(took == units, cost, np.minimum(cost, self._pool(got, took, cost, np.maximum(units, 1))))
                pool[took == 0] = 0
                self.pooled[rows] = pool
                matched[got] += took
                paid[got] += pool
            if short.any():
                self.slices.append((rows[short], np.full(short.sum(), -1), need[short], np.zeros(short.sum(), np.int64)))
        self.paid += paid

    def _pool(self, own: np.ndarray, part: np.ndarray, cost: np.ndarray, units: np.ndarray) -> np.ndarray:
        """part / units of the cost, half cents as Decimal's 28 digits of the cost a unit have them."""
        out = _half_up(part, cost, units)
        for k in np.flatnonzero((2 * part * cost + units) % (2 * units) == 0).tolist():
            unit = int(self.unit[own[k]])
            each = Decimal(int(cost[k])).scaleb(-2) / Decimal(int(units[k]) * unit).scaleb(-10)
            out[k] = int((Decimal(int(part[k]) * unit).scaleb(-10) * each).quantize(CENT, ROUND_HALF_UP).scaleb(2))
        return out

    def _dearest(self, own: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of each group the open lot of the highest basis a unit, -1 where none is open."""
        if not len(own) or not len(self.row):
            return np.full(len(own), -1)
        first = self.first[own]
        lots = first[:, None] + np.arange(max(1, int((end - first).max())))
        lots = np.minimum(lots, end[:, None] - 1)  # the last one again, which argmax passes by
        none = end == first
        lots[none] = 0
        left = self.left[lots]
        ratio = np.where(left > 0, self.basis[lots] / np.maximum(left, 1), -1.0)
        best = ratio.argmax(1)
        at = np.arange(len(own))
        lot, top = lots[at, best], ratio[at, best]
        near = (ratio >= (top * (1 - 1e-12))[:, None]) & (lots != lot[:, None])
        self.bad[own[near.any(1) & (top >= 0) & ~none]] = True
        return np.where(none | (top < 0), -1, lot)

    def _settle(self) -> None:
        """Under average cost the open lots share what the pool holds, the last one taking the rest."""
        own = self.group[self.row]
        average = self.how[own] == 1
        open_ = np.flatnonzero(average & (self.left > 0))
        self.basis[average] = 0
        if not len(open_):
            return
        g, left = own[open_], self.left[open_]
        begin = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        size = np.diff(begin, append=len(g))
        units = np.repeat(np.add.reduceat(left, begin), size)
        last = np.cumsum(size) - 1
        cost = (self.costs[np.append(self.first, len(self.row))[g + 1]] - self.costs[self.first[g]]) - self.paid[g]
        share = self._pool(g, left, cost, units)
        share[last] = 0
        share[last] = cost[last] - np.add.reduceat(share, begin)
        self.basis[open_] = share

    def tables(self, account: np.ndarray, security: np.ndarray):
        """Lots and gains of all groups that are not bad, as record batches of ``WALKED``."""
        names = [n.split()[0] for n in WALKED.replace("\n", " ").replace("(28,10)", "").replace("(18,2)", "").split(", ")]
        days = lambda x, **o: pa.array(x.astype(np.int32), pa.int32(), **o).cast(pa.date32())
        unit = self.unit[self.group]

        def batch(kind, rows, lot_event, acquired, disposed, quantity, remaining, basis, kept, proceeds, gain, long_term, incomplete):
            n = len(rows)
            cents, none = lambda x: pa.nulls(n, pa.decimal128(18, 2)) if x is None else _decimal_array(x, 18, 2), pa.nulls
            how = pa.DictionaryArray.from_arrays(pa.array(codes[self.group[rows]]), pa.array(names_of)).cast(pa.string())
            cols = [pa.repeat(kind, n), pa.array(account[rows]), pa.array(security[rows]), pa.array(self.event[rows]), lot_event, acquired, disposed if disposed is not None else none(n, pa.date32()),
                    _decimal_array(quantity, 28, 10), none(n, pa.decimal128(28, 10)) if remaining is None else _decimal_array(remaining, 28, 10), cents(basis), cents(kept), cents(proceeds), cents(gain),
                    none(n, pa.bool_()) if long_term is None else pa.array(long_term), pa.array(incomplete), how]
            return pa.RecordBatch.from_arrays(cols, names=names)

        kinds = [None if m is None else str(m) for m in self.method.tolist()]
        names_of = list(dict.fromkeys(kinds))
        codes = np.array([names_of.index(k) for k in kinds], np.int32)

        good = ~self.bad[self.group[self.row]]
        rows = self.row[good]
        u = unit[rows]
        if len(rows):
            yield batch("lot", rows, pa.array(self.event[rows]), days(self.day[rows]), None, self.whole[good] * u, self.left[good] * u, self.cost[good], self.basis[good], None, None, None, np.zeros(len(rows), bool))
        if not self.slices:
            return
        rows, lot, q, basis = (np.concatenate(x) for x in zip(*self.slices, strict=True))
        keep = np.flatnonzero((self.kind[rows] == SELL) & ~self.bad[self.group[rows]])
        keep = keep[np.argsort(rows[keep], kind="stable")]
        rows, lot, q, basis = rows[keep], lot[keep], q[keep], basis[keep]
        if not len(rows):
            return
        begin = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        last = np.append(begin[1:], len(rows)) - 1
        open_ = lot < 0
        average = self.how[self.group[rows]] == 1
        if average.any():
            size = np.diff(begin, append=len(rows))
            matched = np.repeat(np.add.reduceat(np.where(open_, 0, q), begin), size)
            share = np.where(open_, 0, _half_up(self.pooled[rows], q, np.maximum(matched, 1)))
            final = last - open_[last]  # the last that is matched
            final = final[final >= begin]
            first = begin[~open_[begin]]
            share[final] = 0
            share[final] = self.pooled[rows[final]] - np.add.reduceat(share, begin)[~open_[begin]] if len(first) else 0
            basis = np.where(average, share, basis)
        amount = self.amount[rows]
        proceeds = _half_up(amount, q, self.quantity[rows])
        proceeds[last] = 0
        proceeds[last] = amount[last] - np.add.reduceat(proceeds, begin)
        of = self.row[np.maximum(lot, 0)] if len(self.row) else rows
        acquired = np.where(open_, self.day[rows], self.day[of])
        known, back = np.unique(acquired, return_inverse=True)
        year_on = np.array([_year_on(d) for d in known.tolist()], np.int64)[back]
        u = unit[rows]
        yield batch("gain", rows, pa.array(self.event[of], mask=open_), days(acquired), days(self.day[rows]), q * u, None, basis, None, proceeds, proceeds - basis, self.day[rows] > year_on, open_)



def lots_and_gains(events: DataFrame, picks: dict | None = None, chunk_rows: int = 1 << 16) -> DataFrame:
    """DOM30: (account_id, security_id, event_id, date, type, quantity, amount, method) to lots and
    realized gains in one table, ``kind`` telling which.  A group is one account's one security; an event id
    counts once in it.  Groups lie in order side by side; some ``chunk_rows`` of their events are walked at once."""
    picks = picks or {}

    def table(rows: list) -> pa.RecordBatch:
        c = list(zip(*rows, strict=True))
        days = lambda x: pa.array(x, pa.int32()).cast(pa.date32())
        quantity = lambda x: _decimals(x, 28, 10)
        cents = lambda x: _decimals(x, 18, 2)
        to = [pa.array, *[lambda x: pa.array(x, pa.int64())] * 4, days, days, quantity, quantity, cents, cents, cents, cents, lambda x: pa.array(x, pa.bool_()), lambda x: pa.array(x, pa.bool_()), lambda x: pa.array(x, pa.string())]
        return pa.RecordBatch.from_arrays([f(x) for f, x in zip(to, c, strict=True)], names=[n.split()[0] for n in WALKED.replace("\n", " ").replace("(28,10)", "").replace("(18,2)", "").split(", ")])

    def slowly(chunk: pa.Table) -> list:
        """Whole groups one by one."""
        account, security, method, held, seen, rows = None, None, None, [], set(), []

        def close():
            if held and not (method != "specific" and _walk(method, held, rows.append)):
                _by_book(method, held, picks, rows.append)

        c = {n: chunk[n].combine_chunks() for n in chunk.column_names}
        ids = [_list(c[n]) for n in ("account_id", "security_id", "event_id")]
        days = _list(c["date"].cast(pa.int32()))
        for a, s, e, d, t, q, m, how in zip(*ids, days, _list(c["type"]), _integers(c["quantity"]), _integers(c["amount"]), _list(c["method"]), strict=True):
            if a != account or s != security or not held:
                close()
                account, security, method, held, seen = a, s, how, [], set()
            if e in seen:
                continue
            seen.add(e)
            held.append((a, s, (e, d), t, q, m))
        close()
        return rows

    def walk(chunk: pa.Table):
        c = {n: chunk[n].combine_chunks() for n in chunk.column_names}
        rest = chunk
        if not any(c[n].null_count for n in ("account_id", "security_id", "event_id", "date")):
            account, security, event = (c[n].to_numpy().astype(np.int64) for n in ("account_id", "security_id", "event_id"))
            start = np.concatenate([[True], (account[1:] != account[:-1]) | (security[1:] != security[:-1])])
            group = np.cumsum(start) - 1
            order = np.lexsort((event, group))
            again = order[1:][(group[order[1:]] == group[order[:-1]]) & (event[order[1:]] == event[order[:-1]])]
            once = np.ones(len(group), bool)
            once[again] = False
            once = np.flatnonzero(once)
            code = lambda n: (lambda x: (np.array([*x.dictionary.to_pylist(), None], object), x.indices.fill_null(len(x.dictionary)).to_numpy()))(c[n].dictionary_encode())
            names, at = code("type")
            kind = np.array([KINDS.get(n, 0) for n in names], np.int8)[at]
            names, at = code("method")
            quantity, odd_q = _longs(c["quantity"])
            amount, odd_m = _longs(c["amount"])
            day = c["date"].cast(pa.int32()).to_numpy().astype(np.int64)
            starts = np.flatnonzero(start[once])
            many = _Many(starts, kind[once], event[once], day[once], quantity[once], amount[once], names[at[once][starts]], (odd_q | odd_m)[once])
            yield from many.tables(account[once], security[once])
            rest = chunk.filter(pa.array(many.bad[group])) if many.bad.any() else None
        rows = slowly(rest) if rest is not None else []
        for k in range(0, len(rows), 10_000):
            yield table(rows[k : k + 10_000])

    def run(batches):
        """Groups that end are walked as soon as there are enough of them."""
        held, n = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            n += b.num_rows
            if n < chunk_rows:
                continue
            same = np.ones(b.num_rows, bool)
            for k in ("account_id", "security_id"):
                final = b.column(k)[b.num_rows - 1]
                equal = b.column(k).is_null() if not final.is_valid else pc.equal(b.column(k), final).fill_null(False)
                same &= equal.to_numpy(zero_copy_only=False)
            keep = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if not keep:  # one group fills the batch
                continue
            whole = pa.Table.from_batches([*held[:-1], b.slice(0, keep)])
            held, n = [b.slice(keep)], b.num_rows - keep
            yield from walk(whole)
        if held:
            yield from walk(pa.Table.from_batches(held))

    order = F.lit(1)
    for kind, rank in DAY_ORDER.items():
        order = F.when(F.col("type") == kind, rank).otherwise(order)
    x = events.repartition("account_id", "security_id").sortWithinPartitions("account_id", "security_id", "date", order, "event_id")
    x = x.select("account_id", "security_id", "event_id", "date", "type", F.col("quantity").cast("decimal(28,10)").alias("quantity"), F.col("amount").cast("decimal(18,2)").alias("amount"), "method")
    x = x.mapInArrow(run, WALKED)
    sha = lambda prefix, *parts: F.concat(F.lit(prefix), sha16(*parts))
    lot = F.when(F.col("lot_event").isNull(), "unmatched").otherwise(sha("lot_", F.col("account_id"), F.col("security_id"), F.col("lot_event")))
    x = x.withColumn("lot_id", lot).withColumn("id", F.when(F.col("kind") == "lot", F.col("lot_id")).otherwise(sha("rg_", F.col("event_id"), F.col("lot_id"))))
    x = x.withColumn("term", F.when(F.col("long_term"), "long").when(~F.col("long_term"), "short"))
    return x.select([c.split()[0] for c in SCHEMA.replace("\n", " ").replace("(28,10)", "").replace("(18,2)", "").split(", ")])


def open_lots(events: DataFrame, picks: dict | None = None) -> DataFrame:
    """SVC06: the lots that still hold something, with what is left of their quantity and basis."""
    x = lots_and_gains(events, picks).where("kind = 'lot' and remaining > 0")
    return x.select("account_id", "security_id", "lot_id", "acquired", "remaining", "remaining_basis", "incomplete", "method")


def resolve_prices(prices: DataFrame) -> DataFrame:
    """DOM35: (security_id, date, source, close, currency_code): the source of highest rank that agrees
    with itself; one that gives several closes for a day is withheld."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SOURCE_RANK]), F.col("source"))
    per = prices.withColumn("rank", F.when(rank == 0, F.lit(99)).otherwise(rank)).groupBy("security_id", "date", "source", "rank").agg(F.min("close").alias("low"), F.max("close").alias("high"), F.min("currency_code").alias("currency_code"))
    best = per.where("low = high").groupBy("security_id", "date").agg(F.min_by(F.struct("source", F.col("low").alias("close"), "currency_code"), F.struct("rank", "source")).alias("p"))
    return best.select("security_id", "date", "p.*")


def value_holdings(holdings: DataFrame, prices: DataFrame, as_of: str, splits: DataFrame | None = None) -> DataFrame:
    """DOM36: the last price on or before the day; withheld where a split is newer than the price;
    valued (that day's), carried_forward, unpriced or withheld."""
    day = F.lit(as_of).cast("date")
    last = prices.where(F.col("date") <= day).groupBy("security_id").agg(F.max(F.struct("date", "close")).alias("p")).select("security_id", F.col("p.date").alias("price_date"), F.col("p.close").alias("close"))
    x = holdings.join(last, "security_id", "left")
    if splits is not None:
        newest = splits.where(F.col("date") <= day).groupBy("security_id").agg(F.max("date").alias("split_date"))
        x = x.join(newest, "security_id", "left")
    else:
        x = x.withColumn("split_date", F.lit(None).cast("date"))
    status = F.when(F.col("close").isNull(), "unpriced").when(F.col("split_date") > F.col("price_date"), "withheld").when(F.col("price_date") == day, "valued").otherwise("carried_forward")
    x = x.withColumn("status", status)
    value = F.when(F.col("status").isin("valued", "carried_forward"), (F.col("quantity").cast("decimal(18,6)") * F.col("close").cast("decimal(18,6)")).cast("decimal(18,2)"))
    return x.withColumn("value", value).drop("split_date")


def resolve_rates(wanted: DataFrame, rates: DataFrame, home: str) -> DataFrame:
    """DOM38: (currency_code, date) and (currency_code, date, rate, source): identity, override, stored,
    then the Friday's for a weekend; never any other earlier day."""
    best = rates.groupBy("currency_code", "date").agg(F.min_by("rate", F.when(F.col("source") == "override", 0).otherwise(1)).alias("rate"))
    friday = F.date_sub(F.col("date"), F.greatest(F.lit(0), F.weekday("date") - 4))
    x = wanted.withColumn("friday", friday)
    a = best.select(F.col("currency_code").alias("c1"), F.col("date").alias("d1"), F.col("rate").alias("r1"))
    b = best.select(F.col("currency_code").alias("c2"), F.col("date").alias("d2"), F.col("rate").alias("r2"))
    x = x.join(a, (F.col("currency_code") == F.col("c1")) & (F.col("date") == F.col("d1")), "left").join(b, (F.col("currency_code") == F.col("c2")) & (F.col("friday") == F.col("d2")), "left")
    rate = F.when(F.col("currency_code") == home, F.lit(1).cast("decimal(18,8)")).otherwise(F.coalesce("r1", "r2").cast("decimal(18,8)"))
    return x.withColumn("rate", rate).drop("friday", "c1", "c2", "d1", "d2", "r1", "r2")


def convert(amount: Column, rate: Column) -> Column:
    """DOM39: in cents, half up."""
    return F.round(amount * rate, 2).cast("decimal(18,2)")


def convert_report(rows: DataFrame, amounts: list[str]) -> DataFrame:
    """DOM40: all rows in the home currency, or, where any rate is missing, none, and why."""
    ok = F.bool_and(F.col("rate").isNotNull()).over(W.partitionBy())
    out = rows.withColumn("converted", ok)
    for c in amounts:
        out = out.withColumn(c, F.when(F.col("converted"), convert(F.col(c), F.col("rate"))).otherwise(F.col(c)))
    return out.withColumn("degraded_reason", F.when(~F.col("converted"), "missing_rates"))


def portfolio_total(valued: DataFrame) -> DataFrame:
    """DOM37: one row; null as soon as a valued holding has no rate."""
    have = valued.where("value is not null")
    return have.agg(F.when(F.bool_and(F.col("rate").isNotNull()), F.sum(convert(F.col("value"), F.col("rate")))).cast("decimal(18,2)").alias("total"))


def backfill_plan(*tables: DataFrame, home: str) -> DataFrame:
    """DOM41: for each other currency the earliest date in any of the tables (currency_code, date)."""
    every = tables[0].select("currency_code", "date")
    for t in tables[1:]:
        every = every.unionByName(t.select("currency_code", "date"))
    return every.where(F.col("currency_code") != home).groupBy("currency_code").agg(F.min("date").alias("earliest"))
