"""Clock arithmetic: time parts, half-open slots, day types."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: input timestamps carry minutes and unpadded digits.
TIMESTAMP_FORMAT = "yyyy/M/d H:mm"


def parse_minute(text: Column) -> Column:
    """Minute-resolution timestamp; junk becomes NULL instead of raising."""
    return F.try_to_timestamp(text, F.lit(TIMESTAMP_FORMAT))


def minutes_between(start: Column, end: Column) -> Column:
    return (F.unix_seconds(end) - F.unix_seconds(start)) / F.lit(60.0)


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


@dataclass(frozen=True)
class Horizon:
    """A half-open stretch of the day cut into equal slots."""

    start: int = 0
    span: int = 1440
    width: int = 60

    def __post_init__(self):
        if self.span <= 0 or self.width <= 0 or self.span % self.width:
            raise ValueError(f"a {self.span}-minute span does not divide into {self.width}-minute slots")
        if not 0 <= self.start or self.start + self.span > 1440:
            raise ValueError("a horizon must stay inside one day")

    @property
    def n_slots(self) -> int:
        return self.span // self.width

    def slot(self, ts: Column) -> Column:
        """Slot index, -1 outside the horizon, NULL for an unknown time."""
        offset = minute_of_day(ts) - self.start
        inside = (offset >= 0) & (offset < self.span)
        return F.when(ts.isNull(), F.lit(None)).when(
            inside, F.floor(offset / self.width).cast("int")
        ).otherwise(F.lit(-1)).cast("int")

    def minute(self, slot: Column) -> Column:
        return (slot * self.width + self.start).cast("int")

    def label(self, slot: Column) -> Column:
        """Clock text HH:MM of a slot's start."""
        minute = self.minute(slot)
        return F.format_string("%02d:%02d", F.floor(minute / 60).cast("int"), (minute % 60).cast("int"))

    def timestamp(self, day: Column, slot: Column) -> Column:
        return F.timestamp_seconds(F.unix_date(day).cast("long") * 86400 + self.minute(slot).cast("long") * 60)


HOURLY = Horizon(0, 1440, 60)
MORNING = Horizon(390, 240, 30)  # 06:30 to 10:30 in eight half-hours


@dataclass(frozen=True)
class DayTypes:
    """Which dates count as working days."""

    holidays: tuple[date, ...] = ()
    makeup: tuple[date, ...] = ()
    half_days: tuple[date, ...] = field(default=())

    @staticmethod
    def _among(day: Column, dates: tuple[date, ...]) -> Column:
        return day.isin(*dates) if dates else F.lit(False)

    def is_holiday(self, day: Column) -> Column:
        return self._among(day, self.holidays)

    def is_makeup(self, day: Column) -> Column:
        return self._among(day, self.makeup)

    def is_workday(self, day: Column) -> Column:
        return F.when(self.is_holiday(day), F.lit(False)).when(self.is_makeup(day), F.lit(True)).otherwise(
            F.weekday(day) < 5
        )

    def is_target(self, day: Column) -> Column:
        """Working days, half days left out."""
        return self.is_workday(day) & ~self._among(day, self.half_days)

    def keep(self, day: Column, rule) -> Column:
        """Rule: all, workday, weekend, labelled (workdays and holidays) or a list of dates."""
        if not isinstance(rule, str):
            return self._among(day, tuple(rule))
        rules = {
            "all": lambda: day.isNotNull(),
            "workday": lambda: self.is_workday(day),
            "weekend": lambda: ~self.is_workday(day),
            "labelled": lambda: self.is_workday(day) | self.is_holiday(day),
        }
        if rule not in rules:
            raise ValueError(f"unknown day rule {rule!r}; use {', '.join(rules)} or a list of dates")
        return rules[rule]()

    def effective_weekday(self, day: Column) -> Column:
        """Monday is 0; a holiday counts as Saturday, a make-up workday as Friday."""
        return F.when(self.is_holiday(day), F.lit(5)).when(self.is_makeup(day), F.lit(4)).otherwise(
            F.weekday(day)
        ).cast("int")
