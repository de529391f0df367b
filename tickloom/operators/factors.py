"""Factor computation: expression packs first, Python folds and frames as an escape hatch.

Three ways to write a factor, from fastest to most general:

* aggregate expressions over the feeds (``expression_factors``);
* a mergeable fold in pandas (``fold_factors``), partial states per task, so
  one stock may hold any share of the rows;
* a function over whole frames of one stock and day (``frame_factors``, ``batch_factors``,
  ``cogrouped_factors``), or over its frames one after the other (``streamed_factors``) where a
  stock's day is larger than memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions import times
from tickloom.operators.calendar import attach_history, calendar
from tickloom.operators.state import KEYS, tag_feeds
from tickloom.session import ship_package
from tickloom.sources.hook import HOOK_FORMAT, SliceHook, hook_source


@dataclass(frozen=True)
class DataNeeds:
    """What a factor reads; only the named inputs enter the plan."""

    tick: bool = False
    deal: bool = False
    order: bool = False
    market_days: int = 0
    lookback: int | tuple[int, ...] = 0
    interval_seconds: int = 0
    securities: tuple[str, ...] = ()
    end_times: tuple[str, ...] = ()

    def offsets(self) -> list[int]:
        """Trading-day offsets of the history: a count means 0..count."""
        if isinstance(self.lookback, int):
            return list(range(self.lookback + 1)) if self.lookback > 0 else []
        return sorted(set(self.lookback))


def load_needs(needs: DataNeeds, sources: dict[str, Callable[[], DataFrame]]) -> dict[str, DataFrame]:
    """Open only the declared inputs, restricted to the declared securities."""
    wanted = [k for k in ("tick", "deal", "order") if getattr(needs, k)]
    if needs.market_days:
        wanted.append("market")
    out = {k: sources[k]() for k in wanted}
    if needs.securities:
        out = {k: df.where(F.col("code").isin(*needs.securities)) if "code" in df.columns else df
               for k, df in out.items()}
    return out


def bundle(needs: DataNeeds, frames: dict[str, DataFrame], keys: list[str] = KEYS) -> DataFrame:
    """The declared feeds as one tagged table; with a lookback each row also carries ``day_offset``.

    One table with a ``kind`` column shuffles once, where a join of three feeds
    would shuffle three times and pair rows.
    """
    any_frame = next(iter(frames[k] for k in ("tick", "deal", "order") if k in frames))
    nothing = any_frame.limit(0)
    tagged = tag_feeds(*[frames.get(k, nothing) for k in ("tick", "deal", "order")], keys=keys)
    offsets = needs.offsets()
    if not offsets:
        return tagged.withColumns({"day_offset": F.lit(0), "time_us": times.micros_of_day(F.col("time"))})
    days = calendar(any_frame)
    asked = tagged.select("trade_date", "code").distinct()
    out = attach_history(asked, tagged, days, offsets, how="inner")
    return out.select(
        "trade_date", "code", "day_offset",
        *[F.col(f"hist_{c}").alias(c) for c in tagged.columns if c not in ("trade_date", "code")],
        times.micros_of_day(F.col("hist_time")).alias("time_us"))


def expression_factors(df: DataFrame, keys: list[str], factors: dict[str, Column]) -> DataFrame:
    """Named aggregate expressions per key: the preferred factor form."""
    return df.groupBy(*keys).agg(*[e.alias(n) for n, e in factors.items()])


Frames = Iterator[pd.DataFrame]
#: A slice end behind every time.
WHOLE_DAY = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Fold:
    """A mergeable pandas factor over state frames (key columns plus state columns).

    ``partial(rows, keys)`` reduces any rows to one state row per key,
    ``merge(states, keys)`` reduces state rows the same way, and
    ``finish(states)`` returns the factor columns of each state row.
    """

    state: str
    result: str
    partial: Callable[[pd.DataFrame, list[str]], pd.DataFrame]
    merge: Callable[[pd.DataFrame, list[str]], pd.DataFrame]
    finish: Callable[[pd.DataFrame], pd.DataFrame]
    max_states: int = 200_000


def sum_fold(columns: list[str], state: str, result: str, finish: Callable[[pd.DataFrame], pd.DataFrame]) -> Fold:
    """A fold whose state is column sums."""
    total = lambda rows, keys: rows.groupby(list(keys), as_index=False, sort=False, dropna=False)[columns].sum()
    return Fold(state, result, total, total, finish)


def _names(schema: str) -> list[str]:
    return [part.strip().split()[0] for part in schema.split(",")]


def _key_schema(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)


def _together(df: DataFrame, keys: list[str], order: list[str] = (), walk: list[str] = ()) -> DataFrame:
    """Rows of a key in one task, keys consecutive, in the order of ``walk`` if given.

    The partition count is stated because run-time coalescing judges bytes,
    while the cost here is Python time.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*(walk or keys), *order)


def _starts(frame: pd.DataFrame | dict[str, np.ndarray], keys: list[str]) -> list[int]:
    """Row numbers where a new key begins, and the row count at the end."""
    rows = len(frame[keys[0]])
    if not rows:
        return [0]
    changed = np.zeros(rows, dtype=bool)
    changed[0] = True
    for k in keys:
        column = np.asarray(frame[k])
        changed[1:] |= column[1:] != column[:-1]
    return [*np.flatnonzero(changed).tolist(), rows]


class Rows:
    """Some consecutive rows of a batch; its columns are opened once for all rows cut out of it."""

    __slots__ = ("_batch", "_columns", "_lo", "_hi")

    def __init__(self, batch: pd.DataFrame, columns: dict | None = None, lo: int = 0, hi: int | None = None):
        self._batch, self._columns = batch, {} if columns is None else columns
        self._lo, self._hi = lo, len(batch) if hi is None else hi

    def __len__(self) -> int:
        return self._hi - self._lo

    def __getitem__(self, column: str) -> np.ndarray:
        if column not in self._columns:
            self._columns[column] = self._batch[column].to_numpy()
        return self._columns[column][self._lo:self._hi]

    @property
    def frame(self) -> pd.DataFrame:
        return self._batch.iloc[self._lo:self._hi]


def _runs(batches: Frames, keys: list[str]) -> Iterator[tuple[tuple, Rows]]:
    """(key, rows) of consecutive equal keys in sorted batches; one key is held at a time besides the batch."""
    held_key, held = None, []

    def joined() -> Rows:
        return Rows(pd.concat([r.frame for r in held])) if len(held) > 1 else held[0]

    for batch in batches:
        starts, opened = _starts(batch, keys), {}
        columns = [batch[k].to_numpy() for k in keys]
        for lo, hi in zip(starts, starts[1:]):
            key = tuple([c[lo] for c in columns])
            if held and key != held_key:
                yield held_key, joined()
                held = []
            held_key = key
            held.append(Rows(batch, opened, lo, hi))
    if held:
        yield held_key, joined()


def _pieces(batches: Frames, keys: list[str]) -> Iterator[tuple[tuple, Iterator[pd.DataFrame]]]:
    """(key, frames) of consecutive equal keys in sorted batches; one batch is held at a time."""
    def cut() -> Iterator[tuple[tuple, pd.DataFrame]]:
        for batch in batches:
            starts = _starts(batch, keys)
            columns = [batch[k].to_numpy() for k in keys]
            for lo, hi in zip(starts, starts[1:]):
                yield tuple(c[lo] for c in columns), batch.iloc[lo:hi]

    for key, own in groupby(cut(), key=lambda piece: piece[0]):
        yield key, (rows for _, rows in own)


def fold_factors(df: DataFrame, keys: list[str], fold: Fold) -> DataFrame:
    """Run a fold: states per task where the rows lie, then one merge per key.

    A key sends one state per task that saw it, never its rows, so the merge
    is bounded by the number of tasks.
    """
    states, ids = _names(fold.state), _key_schema(df, keys)
    columns = [*keys, *states]

    def reduce_rows(batches: Frames) -> Frames:
        kept, size = [], 0
        for batch in batches:
            part = fold.partial(batch, keys)[columns]
            kept.append(part)
            size += len(part)
            if size > fold.max_states:
                merged = fold.merge(pd.concat(kept), keys)[columns]
                kept, size = [merged], len(merged)
                if size > fold.max_states // 2:
                    yield merged
                    kept, size = [], 0
        if kept:
            yield fold.merge(pd.concat(kept), keys)[columns]

    def merge_states(batches: Frames) -> Frames:
        carry = None
        for batch in batches:
            rows = batch if carry is None else pd.concat([carry, batch])
            merged = fold.merge(rows, keys)[columns].reset_index(drop=True)
            # The last key of a batch may go on in the next one.
            tail = rows.iloc[-1][list(keys)]
            is_last = (merged[list(keys)] == tail.values).all(axis=1)
            carry = merged[is_last]
            yield finished(merged[~is_last])
        if carry is not None:
            yield finished(carry)

    def finished(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.reset_index(drop=True)
        return pd.concat([rows[list(keys)], fold.finish(rows)[_names(fold.result)]], axis=1)

    ship_package(df.sparkSession)
    partial = df.mapInPandas(reduce_rows, f"{ids}, {fold.state}")
    return _together(partial, keys).mapInPandas(merge_states, f"{ids}, {fold.result}")


class StockData:
    """One stock and day as a frame function sees it.

    ``tick``, ``deal`` and ``order`` are frames, cut out when first asked for, in sequence order;
    ``history[offset]`` holds earlier days. All slices of a stock share the cut frames, and a slice is a
    view up to a place found by bisection. A frame costs some hundred times a plain array, so functions over
    many stocks or slices read ``column``, and ``last_rows`` and ``totals`` answer for all slices at once.
    """

    def __init__(self, code: str, rows: pd.DataFrame | Rows, until_us: int | None = None, feeds: dict | None = None, places: dict | None = None):
        self.code, self._rows, self._until = code, rows if isinstance(rows, Rows) else Rows(rows), until_us
        self._feeds = {} if feeds is None else feeds
        self._places = {} if places is None else places

    def _place(self, kind: str, offset: int = 0) -> tuple[np.ndarray, np.ndarray, bool]:
        """Row numbers of one feed and day, their times, and whether time never falls from row to row."""
        if (kind, offset) not in self._places:
            at = np.flatnonzero((self._rows["kind"] == kind) & (self._rows["day_offset"] == offset))
            us = self._rows["time_us"][at]
            self._places[kind, offset] = at, us, bool((us[1:] >= us[:-1]).all() and (not len(us) or us[-1] == us[-1]))
        return self._places[kind, offset]

    def _whole(self, kind: str, offset: int) -> tuple[pd.DataFrame, np.ndarray, bool]:
        """Rows of one feed and day, their times, and whether time never falls from row to row."""
        if (kind, offset) not in self._feeds:
            at, us, rising = self._place(kind, offset)
            self._feeds[kind, offset] = self._rows.frame.iloc[at], us, rising
        return self._feeds[kind, offset]

    def _cut(self, own, us: np.ndarray, rising: bool, offset: int):
        """``own`` (a frame or an array) up to the slice end."""
        if self._until is None or offset:
            return own
        part = slice(us.searchsorted(self._until, side="right")) if rising else us <= self._until
        return own.iloc[part] if isinstance(own, pd.DataFrame) else own[part]

    def _frame(self, kind: str, offset: int = 0) -> pd.DataFrame:
        return self._cut(*self._whole(kind, offset), offset)

    def column(self, kind: str, name: str, offset: int = 0) -> np.ndarray:
        """One column of a feed in sequence order, as the frame has it."""
        at, us, rising = self._place(kind, offset)
        return self._cut(self._rows[name][at], us, rising, offset)

    def last_rows(self, kind: str, ends: np.ndarray) -> np.ndarray:
        """Place in ``column`` of the newest row, by sequence, of each slice of the whole day; -1 where it has none.
        ``ends`` as of ``end_micros``."""
        _, us, rising = self._place(kind)
        if rising:
            return us.searchsorted(ends, side="right") - 1
        order, seen = self._by_time(us, ends)
        newest = np.concatenate([[-1], np.maximum.accumulate(order)])
        return newest[seen]

    def totals(self, kind: str, name: str, ends: np.ndarray) -> np.ndarray:
        """Sum of a column over each slice of the whole day, without its nulls."""
        at, us, rising = self._place(kind)
        values = self._rows[name][at]
        if values.dtype.kind not in "iub":
            values = np.nan_to_num(values.astype(float), nan=0.0, posinf=np.inf, neginf=-np.inf)
        if rising:
            seen = us.searchsorted(ends, side="right")
        else:
            order, seen = self._by_time(us, ends)
            values = values[order]
        return np.concatenate([[0], values.cumsum()])[seen]

    @staticmethod
    def _by_time(us: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows in order of time, and how many of them each slice has; rows without a time are only in a whole day."""
        order = np.argsort(us, kind="stable")
        return order, np.where(ends == WHOLE_DAY, len(us), us[order].searchsorted(ends, side="right"))

    @cached_property
    def tick(self) -> pd.DataFrame:
        return self._frame("tick")

    @cached_property
    def deal(self) -> pd.DataFrame:
        return self._frame("deal")

    @cached_property
    def order(self) -> pd.DataFrame:
        return self._frame("order")

    @cached_property
    def history(self) -> dict[int, dict[str, pd.DataFrame]]:
        offsets = sorted(set(self._rows["day_offset"]) - {0})
        return {o: {k: self._frame(k, o) for k in ("tick", "deal", "order")} for o in offsets}

    def until(self, second: int | None) -> "StockData":
        """The same stock cut at a slice end, inclusive, so no later row is visible."""
        return self if second is None else StockData(self.code, self._rows, second * 1_000_000, self._feeds, self._places)


def end_second(end_time: str) -> int | None:
    return None if not end_time else int(end_time[:2]) * 3600 + int(end_time[2:4]) * 60 + int(end_time[4:6])


def end_micros(end_times: Iterable[str]) -> np.ndarray:
    """Slice ends in microseconds of the day; a slice without an end is the whole day."""
    seconds = [end_second(e) for e in end_times]
    return np.array([WHOLE_DAY if s is None else s * 1_000_000 for s in seconds], np.int64)


def result_rows(value: object, code: str, end_times: Iterable[str]) -> list[dict]:
    """Any accepted return shape -> rows with ``code`` and ``end_time``.

    Accepted: a dict of values, {code: dict}, {code: {end_time: dict}}, a list
    of dicts, a frame, or nothing. Codes may be missing.
    """
    ends = list(end_times) or [""]
    if value is None or (isinstance(value, dict) and not value):
        return []
    if isinstance(value, pd.DataFrame):
        value = value.to_dict("records")
    if isinstance(value, list):
        rows = [r for r in value if isinstance(r, dict)]
        return [{"code": code, "end_time": ends[0], **r} for r in rows]
    if not isinstance(value, dict):
        raise TypeError(f"a factor returns dicts, lists or frames, not {type(value).__name__}")
    if value and all(isinstance(v, dict) for v in value.values()):
        out: list[dict] = []
        for key, inner in value.items():
            if inner and all(isinstance(v, dict) for v in inner.values()):
                out += [{"code": key, "end_time": e, **r} for e, r in inner.items()]
            else:
                where = {"code": code, "end_time": key} if key in ends and key != code else {"code": key, "end_time": ends[0]}
                out.append({**where, **inner})
        return out
    return [{"code": code, "end_time": ends[0], **value}]


def _result_frame(value: pd.DataFrame, code: str, end_times: Iterable[str], day: object, columns: list[str]) -> pd.DataFrame:
    """``result_rows`` of a frame as a frame."""
    ends = list(end_times) or [""]
    given = {"code": code, "end_time": ends[0]}
    out = value.assign(**{c: v for c, v in given.items() if c not in value.columns}, trade_date=np.full(len(value), day, object))
    return out.reindex(columns=columns).reset_index(drop=True)


def _emit_rows(groups: Iterator[list[dict] | pd.DataFrame], columns: list[str], chunk: int = 5_000) -> Frames:
    """Result rows, or frames of them, as frames of a few thousand rows."""
    pending: list[dict] = []
    frames: list[pd.DataFrame] = []
    for rows in groups:
        if isinstance(rows, pd.DataFrame):
            frames.append(rows)
        else:
            pending += rows
        if len(pending) >= chunk:
            yield pd.DataFrame(pending, columns=columns)
            pending = []
        if sum(map(len, frames)) >= chunk:
            yield pd.concat(frames, ignore_index=True)
            frames = []
    if pending:
        yield pd.DataFrame(pending, columns=columns)
    if frames:
        yield pd.concat(frames, ignore_index=True)


def _result_schema(result: str) -> tuple[str, list[str]]:
    return (f"trade_date date, code string, end_time string, {result}",
            ["trade_date", "code", "end_time", *_names(result)])


def frame_factors(tagged: DataFrame, fn: Callable, result: str, end_times: Iterable[str] = ("",)) -> DataFrame:
    """``fn(data, code, date, end_time)`` per stock, day and slice.

    Frames are cut at the slice end before the call. ``result`` declares the
    factor columns; undeclared keys are dropped and missing ones are null.
    """
    ship_package(tagged.sparkSession)
    ends = tuple(end_times)
    schema, columns = _result_schema(result)

    def run(batches: Frames) -> Frames:
        def groups() -> Iterator[list[dict]]:
            for (day, code), rows in _runs(batches, KEYS):
                data = StockData(code, rows)
                found = [r for e in ends for r in result_rows(fn(data.until(end_second(e)), code, day, e), code, [e])]
                yield [{**r, "trade_date": day} for r in found]
        return _emit_rows(groups(), columns)

    return _together(tagged, KEYS, ["seq_num"]).mapInPandas(run, schema)


def batch_factors(tagged: DataFrame, fn: Callable, result: str, batches: int, end_times: Iterable[str] = ("",),
                  codes_per_call: int = 100) -> DataFrame:
    """``fn({code: data}, codes, date, end_times)`` per day and group of codes.

    A task walks its rows stock by stock and calls the function after ``codes_per_call`` stocks, so
    memory follows that number and not the market; no group is refused for its size. Stocks are dealt to tasks
    one by one, so a group is shared by all tasks. A function over many slices returns a frame.
    """
    keyed = tagged.withColumn("_batch", F.pmod(F.xxhash64("code"), F.lit(batches)))
    ship_package(tagged.sparkSession)
    ends = tuple(end_times)
    schema, columns = _result_schema(result)

    def run(parts: Frames) -> Frames:
        def groups() -> Iterator[list[dict]]:
            held, data = None, {}

            def call() -> list[dict] | pd.DataFrame:
                value = fn(data, sorted(data), held[0], list(ends))
                if isinstance(value, pd.DataFrame):
                    return _result_frame(value, "", ends, held[0], columns)
                return [{**r, "trade_date": held[0]} for r in result_rows(value, "", ends)]

            for (day, batch, code), rows in _runs(parts, ["trade_date", "_batch", "code"]):
                if data and (held != (day, batch) or len(data) >= codes_per_call):
                    yield call()
                    data = {}
                held, data[code] = (day, batch), StockData(code, rows)
            if data:
                yield call()
        return _emit_rows(groups(), columns)

    return _together(keyed, KEYS, ["seq_num"], ["trade_date", "_batch", "code"]).mapInPandas(run, schema)


def streamed_factors(tagged: DataFrame, fn: Callable, result: str) -> DataFrame:
    """``fn(code, date, frames)`` per stock and day, the rows coming as frames in sequence order.

    Only one frame is in memory, so a stock's day may be larger; what the function leaves unread is skipped.
    """
    ship_package(tagged.sparkSession)
    schema, columns = _result_schema(result)

    def run(batches: Frames) -> Frames:
        def groups() -> Iterator[list[dict]]:
            for (day, code), frames in _pieces(batches, KEYS):
                yield [{**r, "trade_date": day} for r in result_rows(fn(code, day, frames), code, [""])]
        return _emit_rows(groups(), columns)

    return _together(tagged, KEYS, ["seq_num"]).mapInPandas(run, schema)


def cogrouped_factors(left: DataFrame, right: DataFrame, fn: Callable, result: str) -> DataFrame:
    """``fn(code, date, left_frame, right_frame)`` for two inputs of different shape.

    Both inputs lie under each other with a side mark, sorted by day, code and side, so one shuffle
    brings them together and a task walks both at once with one batch and one stock in memory, whatever the market's
    size. A batch becomes one frame a side, of which stocks get their rows; do not write into them.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ship_package(left.sparkSession)
    schema, _ = _result_schema(result)
    out = to_arrow_schema(StructType.fromDDL(schema))
    names = [df.columns for df in (left, right)]
    laid = [df.select(*KEYS, F.lit(side).alias("_side"), F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(df.columns)]).alias(f"_{side}"))
            for side, df in enumerate((left, right))]
    both = laid[0].unionByName(laid[1], allowMissingColumns=True)
    kinds = [to_arrow_schema(StructType().add("s", both.schema[f"_{side}"].dataType))[0].type for side in (0, 1)]

    def frame(parts: list, side: int) -> pd.DataFrame:
        whole = pa.chunked_array(parts, kinds[side])
        return pa.Table.from_arrays([pa.chunked_array([c.field(i) for c in whole.chunks], whole.type[i].type) for i in range(len(names[side]))],
                                    names=names[side]).to_pandas()

    def opened(column: pa.StructArray, side: int) -> pd.DataFrame | None:
        """A side's rows of a batch as one frame; none where a null would change a number's type for other stocks too."""
        if any(c.null_count and not (pa.types.is_floating(c.type) or pa.types.is_string(c.type) or pa.types.is_date(c.type)) for c in column.flatten()):
            return None
        return frame([column], side)

    def stocks(batches) -> Iterator[tuple]:
        """(day, code, left frame, right frame)."""
        held, parts, ready = None, ([], []), [None, None]
        nothing = [frame([], side) for side in (0, 1)]

        def own_frames() -> list[pd.DataFrame]:
            return [ready[side] if ready[side] is not None else frame(parts[side], side) if parts[side] else nothing[side].copy() for side in (0, 1)]

        for batch in batches:
            keys = {k: batch.column(k).to_pandas(date_as_object=True).to_numpy() for k in [*KEYS, "_side"]}
            starts = _starts(keys, [*KEYS, "_side"])
            sides = [batch.column(f"_{side}").filter(pa.array(keys["_side"] == side)) for side in (0, 1)]
            frames, at = [opened(column, side) for side, column in enumerate(sides)], [0, 0]
            for lo, hi in zip(starts, starts[1:]):
                key, side = (keys["trade_date"][lo], keys["code"][lo]), keys["_side"][lo]
                if held is not None and held != key:
                    yield *held, *own_frames()
                    parts, ready = ([], []), [None, None]
                held = key
                first, at[side] = at[side], at[side] + hi - lo
                # The last rows of a batch may go on in the next one.
                if frames[side] is not None and not parts[side] and hi < batch.num_rows:
                    ready[side] = frames[side].iloc[first:at[side]]
                    ready[side].index = pd.RangeIndex(hi - lo)
                else:
                    parts[side].append(sides[side].slice(first, hi - lo))
        if held is not None:
            yield *held, *own_frames()

    def run(batches):
        pending: list[dict] = []

        def full() -> pa.RecordBatch:
            columns = [pa.array([r.get(f.name) for r in pending], f.type, from_pandas=True) for f in out]
            return pa.RecordBatch.from_arrays(columns, schema=out)

        for day, code, *frames in stocks(batches):
            value = fn(code, day, *frames)
            pending += [{**r, "trade_date": day} for r in result_rows(value, code, [""])]
            if len(pending) >= 5_000:
                yield full()
                pending = []
        if pending:
            yield full()

    return _together(both, KEYS, ["_side"]).mapInArrow(run, schema)


def emit(results: DataFrame, hook: SliceHook) -> None:
    """Hand the rows of every (day, slice) to an output hook, on the executors and in one job."""
    ship_package(results.sparkSession)
    results.sparkSession.dataSource.register(hook_source(hook))
    keys = ["trade_date", "end_time"]
    results.repartition(*keys).sortWithinPartitions(*keys).write.format(HOOK_FORMAT).mode("append").save()


def momentum(panel: DataFrame, n: int, code: str = "code", day: str = "trade_date", close: str = "close") -> DataFrame:
    """close / close n observations ago - 1 over non-null closes; null without n + 1 of them.

    The window walks one row per trading day of a stock.
    """
    w = W.partitionBy(code).orderBy(day)
    priced = panel.where(F.col(close).isNotNull()).select(
        code, day, (F.try_divide(F.col(close), F.lag(close, n).over(w)) - 1).alias("momentum"), F.lit(True).alias("_priced"))
    rows = panel.select(code, day).join(priced, [code, day], "left")
    held = F.last(F.when(F.col("_priced"), F.struct("momentum")), ignorenulls=True)
    return rows.select(code, day, held.over(w.rowsBetween(W.unboundedPreceding, 0))["momentum"].alias("momentum"))


def liquidity_mask(panel: DataFrame, code: str = "code", amount: str = "amount", cap: str = "cap",
                   price: str = "close", window: int = 252, min_days: int = 10, min_amount: float = 35e6,
                   min_cap: float = 0.0, price_band: tuple[float, float] = (0.0, float("inf"))) -> DataFrame:
    """Tradability per stock and day: mean amount over the window, a size floor and a price band.

    Our own reading of the published parameters; the original body is not public.
    """
    w = W.partitionBy(code).orderBy("trade_date").rowsBetween(-(window - 1), 0)
    out = panel.withColumns({
        "mean_amount": F.avg(amount).over(w), "amount_days": F.count(amount).over(w)})
    liquid = (F.col("amount_days") >= min_days) & (F.col("mean_amount") >= min_amount)
    sized = F.col(cap) >= min_cap if cap in panel.columns else F.lit(True)
    return out.withColumn("tradable", F.coalesce(
        liquid & sized & F.col(price).between(*price_band), F.lit(False)))


def inference_inputs(current: DataFrame, previous: DataFrame, panel: DataFrame, universe: DataFrame,
                     composition: DataFrame) -> DataFrame:
    """One row per (day, code) of the universe: current factors, previous day's factors,
    panel attributes and composition columns."""
    out = current.join(universe, "code", "left_semi")
    for extra in (previous, panel, composition):
        fresh = [c for c in extra.columns if c not in out.columns or c in ("trade_date", "code")]
        out = out.join(extra.select(*fresh), ["trade_date", "code"], "left")
    return out
