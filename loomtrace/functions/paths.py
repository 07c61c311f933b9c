"""Path expressions: change-target classes, plan files, skills, normalisation."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from loomtrace import dims


def forward(c: Column) -> Column:
    return F.replace(c, F.lit("\\"), F.lit("/"))


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def dirname(c: Column) -> Column:
    return F.when(c.contains("/"), F.regexp_replace(c, r"/[^/]*$", "")).otherwise(F.lit(""))


def change_target(path: Column) -> Column:
    """code / test / doc / config / lockfile / other of a write target, first match wins."""
    p = forward(path)
    name = F.lower(basename(p))
    ext = F.when(name.contains("."), F.element_at(F.split(name, r"\."), -1)).otherwise(F.lit(""))
    stem = F.element_at(F.split(name, r"\."), 1)
    return (
        F.when(path.isNull() | (path == ""), "other")
        .when(p.rlike("(?i)" + dims.SCRATCH_PATTERN), "other")
        .when(name.isin(dims.LOCKFILES), "lockfile")
        .when(p.rlike("(?i)" + dims.TEST_PATH_PATTERN), "test")
        .when(ext.isin(dims.CODE_EXTS), "code")
        .when(ext.isin(dims.DOC_EXTS) | stem.isin(dims.DOC_NAMES), "doc")
        .when(ext.isin(dims.CONFIG_EXTS) | name.isin(dims.CONFIG_NAMES), "config")
        .otherwise("other")
    )


def is_plan_file(path: Column) -> Column:
    return F.coalesce(forward(path).rlike("(?i)" + dims.PLAN_FILE_PATTERN), F.lit(False))


def is_compounding(path: Column) -> Column:
    return F.coalesce((path != "") & forward(path).rlike("(?i)" + dims.COMPOUNDING_PATTERN), F.lit(False))


def skill_of_path(path: Column) -> Column:
    name = F.regexp_extract(forward(path), dims.SKILL_FILE_PATTERN, 1)
    return F.when(name != "", name)


def skills_in_command(command: Column) -> Column:
    return F.regexp_extract_all(command, F.lit(dims.SKILL_FILE_PATTERN), F.lit(1))


def workflow_parent(path: Column) -> Column:
    v = F.regexp_extract(forward(path), dims.WORKFLOW_FILE_PATTERN, 1)
    return F.when(v != "", v)


def workflow_agent(path: Column) -> Column:
    v = F.regexp_extract(forward(path), dims.WORKFLOW_FILE_PATTERN, 2)
    return F.when(v != "", v)


def is_subagent_path(path: Column) -> Column:
    return F.array_contains(F.split(forward(path), "/"), "subagents")


def is_absolute(path: Column) -> Column:
    p = forward(path)
    return F.coalesce(p.startswith("/") | p.rlike(r"^[A-Za-z]:/"), F.lit(False))


def join_cwd(cwd: Column, path: Column) -> Column:
    """Relative targets are read against the working directory."""
    joined = F.when(cwd.endswith("/"), F.concat(cwd, path)).otherwise(F.concat(cwd, F.lit("/"), path))
    return F.when((F.coalesce(cwd, F.lit("")) != "") & (path != "") & ~is_absolute(path), joined).otherwise(path)


def normalize(path: Column) -> Column:
    """Collapse '.', '..' and repeated separators the way POSIX normpath does."""
    absolute = path.startswith("/")

    def step(acc: Column, seg: Column) -> Column:
        last = F.element_at(acc, -1)
        poppable = (F.size(acc) > 0) & (F.when(F.size(acc) > 0, last).otherwise(F.lit("")) != "..")
        return (
            F.when(seg.isin("", "."), acc)
            .when((seg == "..") & poppable, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .when((seg == "..") & absolute, acc)
            .otherwise(F.concat(acc, F.array(seg)))
        )

    segs = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    lead = F.when(path.rlike(r"^//[^/]"), "//").when(absolute, "/").otherwise("")
    out = F.concat(lead, F.array_join(segs, "/"))
    needs = path.rlike(r"(^|/)\.{1,2}(/|$)|//|.+/$")
    return F.when(path == "", F.lit("")).when(~needs, path).otherwise(F.when(out == "", ".").otherwise(out))
