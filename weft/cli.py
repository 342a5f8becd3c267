"""The command line: ``report`` (the default), ``diff BEFORE AFTER`` and ``cache clear``."""

from __future__ import annotations

import sys
from collections.abc import Callable
from posixpath import abspath

from pyspark.sql import SparkSession

from weft.plans import sidecar
from weft.plans.options import DEPTHS, TYPES, FlagError, Options, granularity, positive

USAGE = """usage: weft --config FILE [--config FILE ...] [options]
       weft diff BEFORE.json AFTER.json
       weft cache clear [--cache-folder FOLDER]

  --depth N            1 to 5: how small findings may be, and how many are shown (3)
  --min-nodes N        least nodes of a finding
  --min-lines N        least lines of a finding
  --granularity G      auto, dir, file, or a number of folders
  --types T            include, exclude or only types
  --budget-tokens N    length of the report
  --max-locations N    files named for a finding
  --include-generated  analyse generated files too
  --no-banner-scan     do not look for marks of generated files in them
  --exclude GLOB       leave out matching paths; may be given again
  --json FILE          write the report as JSON too
  --cache-folder DIR   keep what is read from files there
  --no-cache           do not
  --help               this text
"""
SWITCHES = {"--include-generated", "--no-banner-scan", "--no-cache", "--help"}
REPEATED = {"--config", "--exclude"}
SINGLE = {"--depth", "--min-nodes", "--min-lines", "--granularity", "--types", "--budget-tokens", "--max-locations", "--json", "--cache-folder"}


def flags(argv: list[str]) -> dict:
    """Flags with their values; FlagError for one that is unknown, lacks its value or is given twice."""
    out: dict = {f: [] for f in REPEATED}
    i = 0
    while i < len(argv):
        name, equals, value = argv[i].partition("=")
        if name in SWITCHES and not equals:
            out[name] = True
        elif name in REPEATED | SINGLE:
            if not equals:
                i += 1
                if i == len(argv):
                    raise FlagError(f"{name} wants a value")
                value = argv[i]
            if name in REPEATED:
                out[name].append(value)
            elif name in out:
                raise FlagError(f"{name} is given twice")
            else:
                out[name] = value
        else:
            raise FlagError(f"unknown argument {argv[i]!r}")
        i += 1
    return out


def options(given: dict) -> Options:
    depth = positive("--depth", given.get("--depth", "3"))
    if depth not in DEPTHS:
        raise FlagError(f"--depth wants 1 to {max(DEPTHS)}, not {depth}")
    more: dict = {name: positive(flag, given[flag]) for flag, name in (("--min-nodes", "min_nodes"), ("--min-lines", "min_lines"), ("--budget-tokens", "budget_tokens"), ("--max-locations", "max_locations")) if flag in given}
    if "--granularity" in given:
        more["granularity"] = granularity(given["--granularity"])
    if (types := given.get("--types", "include")) not in TYPES:
        raise FlagError(f"--types wants include, exclude or only, not {types!r}")
    return Options.of_depth(depth, types=types, include_generated="--include-generated" in given, banner_scan="--no-banner-scan" not in given, exclude=tuple(given["--exclude"]), cache="--no-cache" not in given, **more)


def local_session() -> SparkSession:
    spark = SparkSession.builder.appName("weft").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv: list[str], out: Callable[[str], object] = sys.stdout.write, err: Callable[[str], object] = sys.stderr.write, session: Callable[[], SparkSession] = local_session) -> int:
    """0 when it ran, 2 for arguments that can't be understood, 1 for anything else that is wrong."""
    try:
        if argv[:1] == ["diff"]:
            if len(argv) != 3:
                raise FlagError("diff wants two reports")
            before, after = (sidecar.read(session(), p if "://" in p else abspath(p)) for p in argv[1:])
            out(sidecar.difference_text(sidecar.difference(before, after)))
            return 0
        if argv[:1] == ["cache"]:
            from weft.streaming.incremental import clear

            given = flags(argv[2:])
            if argv[1:2] != ["clear"]:
                raise FlagError("cache wants: clear")
            found = clear(session(), given.get("--cache-folder", abspath(".weft-cache")))
            out("cache cleared\n" if found else "there was no cache\n")
            return 0
        given = flags(argv)
        if "--help" in given:
            out(USAGE)
            return 0
        asked = options(given)
        if not given["--config"]:
            raise FlagError("--config is missing")
    except FlagError as e:
        err(f"weft: {e}\n{USAGE}")
        return 2
    except Exception as e:
        err(f"weft: {e}\n")
        return 1
    try:
        from weft.plans.report import Engine

        spark = session()
        made = Engine(spark, given.get("--cache-folder")).report([c if "://" in c else abspath(c) for c in given["--config"]], asked)
        if "--json" in given:
            sidecar.write(spark, made.json, given["--json"] if "://" in given["--json"] else abspath(given["--json"]))
        out(made.markdown)
        return 0
    except Exception as e:
        err(f"weft: {e}\n")
        return 1
