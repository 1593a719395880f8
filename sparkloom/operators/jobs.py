"""Jobs: ordered steps that read, plan and publish; all or nothing, with a run log; nothing is written in a dry run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from sparkloom.operators.triggers import Triggers
from sparkloom.sources.sinks import log_run
from sparkloom.sources.versions import Conflict, current, publish_all, versions


@dataclass
class Job:
    """``preconditions`` are checked before anything is read (each gives a message if it fails); ``collect`` gives the new tables by
    name, none if there is nothing to do. ``reads`` names further published tables that it looks at. ``undo`` removes what a failed
    attempt stored outside of tables, such as media files."""

    name: str
    collect: Callable[[], dict[str, DataFrame]]
    preconditions: list[Callable[[], str | None]] = field(default_factory=list)
    reads: tuple[str, ...] = ()
    undo: Callable[[], None] | None = None

    def check(self) -> None:
        for test in self.preconditions:
            if message := test():
                raise ValueError(f"{self.name}: {message}")


#: Attempts of a job whose tables others publish while it runs.
ATTEMPTS = 3


def _attempt(spark: SparkSession, job: Job, root: str, dry_run: bool, triggers: Triggers | None) -> dict[str, DataFrame]:
    held = versions(spark, root)
    tables = job.collect()
    if tables and not dry_run:
        before = {n: current(spark, root, n, held) for n in tables}
        places = publish_all(spark, tables, root, held[0], job.reads)
        if triggers is not None:
            triggers.fire(before, {n: spark.read.parquet(p) for n, p in places.items()})
    return tables


def run(spark: SparkSession, jobs: list[Job], root: str, dry_run: bool = False, triggers: Triggers | None = None) -> dict[str, DataFrame]:
    """Runs the jobs in order. The tables of a job are published at once; a failure, while they are collected or written, publishes none of
    them, undoes what else was stored, and stops the rest. A job that finds its tables published by others meanwhile is run anew, from what they
    published. ``triggers`` are told what each publication changed. Dry runs give the tables without writing them."""
    for job in jobs:
        job.check()
    done: dict[str, DataFrame] = {}
    for job in jobs:
        tables: dict[str, DataFrame] = {}
        for left in reversed(range(ATTEMPTS)):
            try:
                tables = _attempt(spark, job, root, dry_run, triggers)
                break
            except Exception as e:
                if job.undo is not None:
                    job.undo()
                if isinstance(e, Conflict) and left:
                    continue
                if not dry_run:
                    log_run(spark, f"{root.rstrip('/')}/runs", job.name, "", False, notes=str(e)[:1000])
                raise
        if not dry_run and tables:
            log_run(spark, f"{root.rstrip('/')}/runs", job.name, "", True, {name: "published" for name in tables})
        done.update(tables)
    return done


#: The order of a full synchronisation; a setup run stops after the periods.
ORDER = ("parliaments", "elections", "periods", "candidacies", "mandates")


def in_order(jobs: dict[str, Job], only_setup: bool = False) -> list[Job]:
    return [jobs[n] for n in (ORDER[:3] if only_setup else ORDER) if n in jobs]
