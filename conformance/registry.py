"""All registered queries with their SQL."""

from __future__ import annotations

from . import cases_audit, cases_captures, cases_functions, cases_measures, cases_questions, cases_streams
from .derived import Derived

_MODULES = (cases_measures, cases_functions, cases_captures, cases_questions, cases_audit, cases_streams)


def _run(fn):
    def query(spark, sf_dir):
        return fn(Derived(spark, sf_dir))

    return query


def _cases():
    cases = {}
    for module in _MODULES:
        cases.update(module.CASES)
    return cases


def queries():
    return {key: _run(fn) for key, (fn, _) in _cases().items()}


def oracle_sql():
    return {key: sql for key, (_, sql) in _cases().items() if sql is not None}
