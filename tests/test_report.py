"""Projects from disk to report, sidecar, difference and command line."""

import json

import pytest
from pyspark.sql import functions as F

from weft import cli
from weft.functions import text as X
from weft.functions.globs import regex_of
from weft.operators import variation as V
from weft.plans import markdown, sidecar
from weft.plans.options import FlagError, Options, granularity, positive
from weft.plans.report import Engine
from weft.sources import code
from weft.sources import project as P

SUM = """export function total(rows: Row[]): number {
  let sum = 0;
  for (const row of rows) {
    if (row.active && row.amount > 10) {
      sum += row.amount * 2;
    }
  }
  return sum;
}
"""
RENAMED = SUM.replace("total", "weigh").replace("rows", "items").replace("row", "item").replace("sum", "all")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    files = {
        "tsconfig.json": '{"include": ["src/**/*"], // all\n "exclude": ["src/left"],}',
        "src/core/a.ts": f'import {{ b }} from "../api/b";\nexport const one = 1;\n{SUM}',
        "src/api/b.ts": f'import {{ one }} from "../core/a";\nexport const b = one;\n{SUM}',
        "src/app/c.ts": f'import {{ one }} from "../api/index";\nimport type {{ T }} from "../core/types.js";\n{RENAMED}',
        "src/api/index.ts": 'export * from "../core/a";\n',
        "src/core/types.ts": "export interface T { a: string; b: number; c: boolean }\nexport type U = { a: string; b: number };\n",
        "src/app/c.test.ts": 'import { weigh } from "./c";\ntest("x", () => { expect(weigh([])).toBe(0); });\n',
        "src/dist/made.ts": SUM,
        "src/core/banner.ts": f"// @generated by a tool\n{SUM}",
        "src/left/out.ts": SUM,
        "other/lone.ts": SUM,
        "node_modules/p/index.ts": SUM,
    }
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return root


@pytest.fixture(scope="module")
def made(spark, folder):
    return Engine(spark, str(folder / ".cache")).report([str(folder / "tsconfig.json")], Options(granularity=2))


def test_globs():
    import re

    for glob, yes, no in (
        ("src/**/*.ts", ["src/a.ts", "src/x/y/z.ts"], ["b/src/a.ts", "src/a.js"]), ("*.{ts,tsx}", ["a.ts", "b.tsx"], ["x/a.ts", "a.js"]), ("a?b[!c].x", ["a1bd.x"], ["a/bd.x", "a1bc.x"]),
        ("**/gen/**", ["gen/x", "a/gen/x/y"], ["gens/x"]), ("a+(b).ts", ["a+(b).ts"], ["aab.ts"]),
    ):
        assert all(re.search(regex_of(glob), p) for p in yes) and not any(re.search(regex_of(glob), p) for p in no)


def test_fragments_nest_and_count():
    rows = code.fragment_rows(SUM)
    by_seq = [r for r in rows]
    top = rows[-1]
    assert top[1] == "Function" and top[7] == -1 and (top[5], top[6]) == (1, 9) and top[3] == 0
    assert all(r[2] <= top[2] and top[3] <= r[3] and r[4] <= top[4] for r in rows) and [r[0] for r in by_seq] == list(range(len(rows)))
    l0, l1 = rows[-1][9], rows[-1][10]
    other = code.fragment_rows(RENAMED)[-1]
    assert l0 != other[9] and code.alpha_renamed(l1) == code.alpha_renamed(other[10])
    assert "Number:10" in l0 and "Number" in l1 and "Number:10" not in l1
    assert code.fragment_rows("") == [] and code.fragment_rows("}") == [] and len(code.fragment_rows("f(")) > 0
    assert not any(r[1] in code.IGNORED for r in rows) and "Parameters" in l0
    assert [r for r in code.fragment_rows(SUM, least_nodes=10, least_lines=3) if r[2] < 10 or r[6] - r[5] < 2] == []


@pytest.mark.parametrize("source, bindings, erased", [
    ('import d from "m"', 1, 0), ('import * as ns from "m"', 1, 0), ('import { a, b as c } from "m"', 2, 0), ('import d, { a, type T } from "m"', 3, 1), ('import type { A, B } from "m"', 2, 2),
    ('import type D from "m"', 1, 1), ('import "m"', 0, 0), ('const x = await import("m")', 0, 0), ('export * from "m"', 1, 0), ('export * as ns from "m"', 1, 0), ('export { a, b as c } from "m"', 2, 0), ('export type { T } from "m"', 1, 1),
    ("import type, { a } from 'm'", 2, 0), ('// import a from "m"\nconst s = `import b from "m"`', None, None), ("import { type } from 'm'", 1, 0),
])
def test_bindings(source, bindings, erased):
    rows = code.import_rows(source)
    assert (not rows) if bindings is None else (sum(r[5] for r in rows), sum(r[4] for r in rows)) == (bindings, erased)
    assert bindings is None or all(r[1] == "m" for r in rows)


def test_project(spark, folder):
    project = P.open_project(spark, [str(folder / "tsconfig.json")], exclude=("**/types.ts",))
    assert sorted(r.path for r in project.files.collect()) == ["src/api/b.ts", "src/api/index.ts", "src/app/c.test.ts", "src/app/c.ts", "src/core/a.ts"]
    assert project.excluded == {"directory": 1, "banner": 1, "pattern": 1}
    assert sorted(r.path for r in project.on_disk.collect()) == ["other/lone.ts", "src/api/b.ts", "src/api/index.ts", "src/app/c.test.ts", "src/app/c.ts", "src/core/a.ts", "src/core/banner.ts", "src/core/types.ts", "src/left/out.ts"]
    both = P.one_per_path([project.files.drop("path"), project.files.drop("path")])
    assert both.count() == 5
    every = P.open_project(spark, [str(folder / "tsconfig.json")], include_generated=True, banner_scan=False)
    assert every.files.count() == 8 and every.excluded == {}
    with pytest.raises(P.EmptyProjectError):
        P.open_project(spark, [str(folder / "tsconfig.json")], exclude=("**",))
    assert P.common_root(["/a/b/c/x.json", "/a/b/d/y.json"]) == "/a/b"
    with pytest.raises(ValueError):
        P.common_root([])


def test_references_are_followed_once():
    graph = {"/r/tsconfig.json": ["a", "./b/tsconfig.json"], "/r/a/tsconfig.json": ["../B"], "/r/b/tsconfig.json": ["../a"], "/r/B/tsconfig.json": []}
    leaves = P.expand_references(["/r/tsconfig.json"], lambda c: c.lower() == "/r/b/tsconfig.json", lambda c: graph.get(c, []))
    assert leaves == ["/r/b/tsconfig.json"]


def test_report(made, folder):
    r = made.json
    assert r["metrics"]["files"] == 6 and r["metrics"]["modules"] == 3 and r["granularity"] == "dir:2"
    assert r["excluded"] == {"directory": 1, "banner": 1} and not r["scope"]["complete"] and {"owner": "other", "missing": 1} not in r["scope"]["gaps"]
    code_rows = [x for x in r["duplication"] if x["section"] == "code"]
    best = code_rows[0]
    assert best["kind"] == "FunctionDeclaration" and {x["path"] for x in best["locations"]} == {"src/core/a.ts", "src/api/b.ts", "src/app/c.ts"} and best["level"] == "L1" and best["copies"] == 3
    assert best["recoverable_lines"] == 14 and best["excerpt"].startswith("function total") or "total" in best["excerpt"]
    assert len(r["cycles"]) == 1 and r["cycles"][0]["members"] == ["api", "core"] and r["metrics"]["largest_scc"] == 2
    assert r["cycles"][0]["file_cycles"]["crossing"] == 1 and r["cycles"][0]["cut"]["src"] == "core" and r["cycles"][0]["residual"] == 1
    assert made.markdown.startswith("# Structure report") and best["id"] in made.markdown and "flowchart LR" in made.markdown


def test_cached_report_is_the_same(spark, folder, made):
    again = Engine(spark, str(folder / ".cache")).report([str(folder / "tsconfig.json")], Options(granularity=2))
    assert again.json == made.json


def test_sidecar_and_difference(spark, tmp_path, made):
    path = str(tmp_path / "r.json")
    sidecar.write(spark, made.json, path)
    assert sidecar.read(spark, path) == json.loads(json.dumps(made.json))
    after = json.loads(json.dumps(made.json))
    gone = after["duplication"].pop(0)["id"]
    after["cycles"].append({"id": "CYC-new"})
    after["metrics"]["duplicated_mass"] = 0
    d = sidecar.difference(made.json, after)
    assert (d.resolved, d.added) == ([gone], ["CYC-new"])
    text = sidecar.difference_text(d)
    assert text.startswith("1 findings resolved, 1 new, duplicated mass -100.0%") and f"  - {gone}\n" in text and "  + CYC-new" in text
    assert sidecar.change(0, 0) == 0 and sidecar.change(0, 3) == 100 and sidecar.change(4, 3) == -25
    for bad in ("{", "[]", "{}", '{"metrics": {"duplicated_mass": "x"}}', json.dumps({"metrics": made.json["metrics"], "duplication": [{}], "cycles": []})):
        with pytest.raises(sidecar.SidecarError, match="some.json"):
            sidecar.parse(bad, "some.json")
    frames = sidecar.metrics_frame(spark, made.json).first(), sidecar.findings_frame(spark, made.json)
    assert frames[0].largest_scc == 2 and frames[1].count() == len(made.json["duplication"]) + 1


def test_command_line(spark, tmp_path, folder, made):
    out, err = [], []

    def run(*argv):
        out.clear()
        err.clear()
        return cli.main(list(argv), out.append, err.append, lambda: spark)

    assert run("--config", str(folder / "tsconfig.json"), "--granularity=2", "--json", str(tmp_path / "a.json"), "--no-cache") == 0 and out[0] == made.markdown
    assert json.loads((tmp_path / "a.json").read_text()) == json.loads(json.dumps(made.json))
    assert run("diff", str(tmp_path / "a.json"), str(tmp_path / "a.json")) == 0 and out[0].startswith("0 findings resolved, 0 new, duplicated mass +0.0%")
    assert run("diff", str(tmp_path / "a.json"), str(tmp_path / "missing.json")) == 1 and run("diff", "x") == 2
    assert run("--help") == 0 and "usage" in out[0]
    for bad in (["--depth", "9"], ["--min-nodes", "0"], ["--min-nodes", "x"], ["--types", "some"], ["--granularity", "wide"], ["--what"], ["--json"], [], ["--depth", "1", "--depth", "2"]):
        assert run(*bad) == 2 and err
    assert run("--config", str(folder / "nothing.json")) == 1 and "nothing.json" in err[0]
    assert run("cache", "clear", "--cache-folder", str(folder / ".cache")) == 0 and out == ["cache cleared\n"]
    assert run("cache", "clear", "--cache-folder", str(folder / ".cache")) == 0 and out == ["there was no cache\n"] and run("cache", "fill") == 2


def test_options():
    assert Options.of_depth(1).min_nodes == 40 and Options().cap("tests") == 5 and Options().cap("types") == 10 and Options(max_findings=3).cap("tests") == 1
    same = Options(exclude=("b", "a"), max_findings=3, budget_tokens=9, max_locations=1)
    assert same.config_hash() == Options(exclude=("a", "b")).config_hash() != Options(min_nodes=16).config_hash()
    assert granularity("3") == 3 and granularity("dir") == "dir" and positive("x", "7") == 7
    for bad in ("-1", "1.5", "", "０"):
        with pytest.raises(FlagError):
            positive("x", bad)


def test_variations():
    a = ["Call", "Id:width", "(", "Number:3", ")", "(", "String:x", ")", "Id:deep", "Number:1"]
    b = ["Call", "Id:width", "(", "Number:4", ")", "(", "String:y", ")", "Id:deep", "Number:1"]
    c = ["Call", "Id:width", "(", "Number:4", ")", "(", "String:z", ")", "Id:deep", "Number:2"]
    assert V.variations([a, b, c]) == [V.Variation("width", 3, False), V.Variation("deep", 2, False)]
    assert V.variations([a, b, c], 5)[0].saturated and not V.variations([a, b, c], 5)[1].saturated
    assert V.variations([a]) == [] and V.variations([a, a[:-1]]) == [] and V.variations([["Number:1"], ["Number:2"]])[0].label == V.UNNAMED
    fields = [["Property", "(", "Id:a", ")", "Property", "(", "Id:k", ")"], ["Property", "(", "Id:b", ")", "Property", "(", "Id:k", ")"]]
    assert V.field_drift(fields) == (1, 2) and V.field_positions(["Member", "Property", "Id:a"]) == [2] and V.field_drift(fields[:1]) == (0, 0)


def test_markdown_parts():
    assert markdown.fence("a ``` b", "x.ts").startswith("````ts\n")
    assert markdown.chart_ids(["a/b", "c"]) == {"a/b": "a/b", "c": "c"} and markdown.chart_ids(["end", "a-b", "a.b", "1"]) == {"end": "m_end", "a-b": "a_b", "a.b": "a_b_2", "1": "m_1"}
    assert markdown.chart_label('a"b') == "a#quot;b" and markdown.lifted(["p/q/a", "p/q/b"]) == ("p/q/", ["a", "b"]) and markdown.lifted(["p/a", "p/b"]) == ("", ["p/a", "p/b"])
    rows = [{"path": f"d{k % 5}/f{k}.ts", "lines": [k]} for k in range(20)]
    assert markdown.spread(rows) == "Spread: d0 (4), d1 (4), d2 (4), elsewhere (8)" and markdown.spread(rows[:12]) == "" and markdown.places(rows, 2).endswith("and 18 more files")
    assert "- a → b (2)" in markdown.chart([str(k) for k in range(30)], [{"src": "a", "dst": "b", "weight": 2, "type_only": False}])


def test_budget_stops_at_the_first_that_does_not_fit(made):
    parts = {"code": ["x" * 40, "y" * 400, "z" * 4], "types": ["t" * 4], "cycles": [], "tests": []}
    full = markdown.within(parts, "", None)
    assert full == {"code": 3, "types": 1, "cycles": 0, "tests": 0}
    assert markdown.within(parts, "", 60) == {"code": 1, "types": 0, "cycles": 0, "tests": 0}
    short = markdown.render(made.json, Options(budget_tokens=250))
    assert "Left out for length" in short and len(short) < len(made.markdown)


def test_test_paths(spark):
    paths = ["src/attest.ts", "src/latest/x.ts", "src/a.test.ts", "src/a.spec.mjs", "src/a.test.txt", "src/a.test.b.ts", "tests", "test/x.ts", "a/__tests__/b.ts"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select(X.is_test_path(F.col("p"))).collect()
    assert [r[0] for r in got] == [False, False, True, True, False, False, False, True, True]
