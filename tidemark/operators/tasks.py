"""Search, order, pages and schedules of tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Order of statuses.
STATUSES = ("PENDING", "SCHEDULED", "RUNNING", "PAUSED", "FAILED", "COMPLETED", "STOPPED")
SORTS = ("created_desc", "created_asc", "name_asc", "name_desc", "status_asc", "status_desc", "progress_desc", "progress_asc")


def status_rank(status: Column) -> Column:
    out = F.lit(len(STATUSES))
    for rank, name in enumerate(STATUSES):
        out = F.when(status == name, rank).otherwise(out)
    return out


def search(tasks: DataFrame, status: str | None = None, keyword: str | None = None) -> DataFrame:
    """Status in either case; the keyword in name, id, schemas or any table name."""
    if status:
        tasks = tasks.where(F.upper("status") == status.upper())
    if keyword:
        word = keyword.lower()
        has = lambda c: F.lower(c).contains(word)
        tasks = tasks.where(has(F.col("name")) | has(F.col("id")) | has(F.col("source_schema")) | has(F.col("target_schema")) | F.exists("tables", has))
    return tasks


def order_of(sort: str) -> list[Column]:
    """Ties: newest first, then id."""
    kind, way = sort.split("_")
    by = {"created": F.col("created_at"), "name": F.lower("name"), "status": status_rank(F.col("status")), "progress": F.col("progress")}[kind]
    first = by.asc() if way == "asc" else by.desc()
    return [first, F.col("id")] if kind == "created" else [first, F.col("created_at").desc(), F.col("id")]


def page(tasks: DataFrame, sort: str, number: int, size: int) -> DataFrame:
    number, size = number if number > 0 else 1, size if size > 0 else 10
    return tasks.orderBy(*order_of(sort)).offset((number - 1) * size).limit(size)


def page_with_total(tasks: DataFrame, sort: str, number: int, size: int) -> DataFrame:
    """A page and, in every row, the number of all tasks."""
    return page(tasks, sort, number, size).join(F.broadcast(tasks.agg(F.count("*").alias("total"))))  # one row


def fresh_snapshots(snapshots: DataFrame, tasks: DataFrame) -> DataFrame:
    """The snapshots (id, status, updated_at) that may be saved: of tasks that are there, are in the same status and are not newer."""
    now = tasks.select("id", F.col("status").alias("now_status"), F.col("updated_at").alias("now_updated"))
    return snapshots.join(now, "id").where("status = now_status and not now_updated > updated_at").select(*snapshots.columns)


def due(tasks: DataFrame, now: Column) -> DataFrame:
    return tasks.where((F.col("status") == "SCHEDULED") & (F.col("scheduled_at") <= now))


def last_business_day(day: Column) -> Column:
    """The last day from Monday to Friday of the day's month."""
    last = F.last_day(day)
    weekday = F.weekday(last)  # Monday is 0
    return F.date_sub(last, F.greatest(weekday - 4, F.lit(0)))


def next_last_business_day(now: Column, hour: int, minute: int) -> Column:
    """The first time after now (without a time zone) that is hour:minute of the last business day of a month."""
    at = lambda month: last_business_day(month).cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(hour), mins=F.lit(minute))
    this = at(now.cast("date"))
    return F.when(this > now, this).otherwise(at(F.add_months(F.trunc(now.cast("date"), "month"), 1)))


#: Names that a schedule may use, and what short forms stand for.
MONTH_NAMES = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
DAY_NAMES = ("sun", "mon", "tue", "wed", "thu", "fri", "sat")
SHORT_FORMS = {"@yearly": "0 0 1 1 *", "@annually": "0 0 1 1 *", "@monthly": "0 0 1 * *", "@weekly": "0 0 * * 0", "@daily": "0 0 * * *", "@midnight": "0 0 * * *", "@hourly": "0 * * * *"}


def _field(said: str, low: int, high: int, names: tuple[str, ...] = (), first: int = 0) -> tuple[list[int], bool]:
    """Values of a schedule's field and whether it is a star: lists, ranges, steps, names (numbered from first)."""
    number = lambda x: names.index(x.lower()) + first if x.lower() in names else int(x)
    out, star = set(), False
    for part in said.split(","):
        span, _, step = part.partition("/")
        if span in ("*", "?"):
            a, b = low, high
            star = star or step in ("", "1")
        else:
            a, dash, b = span.partition("-")
            a = number(a)
            b = number(b) if dash else high if step else a
        step = int(step) if step else 1
        if not low <= a <= b <= high or step < 1:
            raise ValueError(f"{said!r} is no field of values from {low} to {high}")
        out |= set(range(a, b + 1, step))
    return sorted(out), star


def next_cron(now: Column, schedule: str, years: int = 5) -> Column:
    """The first minute after now (without a time zone) that a schedule of five fields (minute, hour, day, month, weekday) or a
    short form allows; null if there is none within some years. If day and weekday are both given, either will do."""
    fields = SHORT_FORMS.get(schedule.strip(), schedule).split()
    if len(fields) != 5:
        raise ValueError(f"a schedule has five fields: {schedule!r}")
    minutes, hours = _field(fields[0], 0, 59)[0], _field(fields[1], 0, 23)[0]
    (days, any_day), (months, _), (weekdays, any_weekday) = _field(fields[2], 1, 31), _field(fields[3], 1, 12, MONTH_NAMES, 1), _field(fields[4], 0, 6, DAY_NAMES)
    slots = F.array(*[F.lit(h * 60 + m) for h in hours for m in minutes])
    today, at = now.cast("date"), F.hour(now) * 60 + F.minute(now)

    def fits(day: Column) -> Column:
        by_day, by_weekday = F.dayofmonth(day).isin(*days), (F.dayofweek(day) - 1).isin(*weekdays)
        return F.month(day).isin(*months) & (by_day & by_weekday if any_day or any_weekday else by_day | by_weekday)

    later = F.get(F.filter(slots, lambda s: s > at), F.lit(0))
    after = F.get(F.filter(F.sequence(F.date_add(today, 1), F.date_add(today, 366 * years)), fits), F.lit(0))
    minute_of = lambda day, slot: day.cast("timestamp_ntz") + F.make_dt_interval(mins=slot)
    return F.when(fits(today) & later.isNotNull(), minute_of(today, later)).otherwise(minute_of(after, F.lit(hours[0] * 60 + minutes[0])))
