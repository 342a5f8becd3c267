"""The report as Markdown, from its JSON; findings that do not fit a budget of tokens are left out from the first that does not."""

from __future__ import annotations

import re
from posixpath import dirname, splitext

from weft.plans.options import Options

#: What a fence calls the code of an ending.
LANGUAGES = {".ts": "ts", ".mts": "ts", ".cts": "ts", ".tsx": "tsx", ".js": "js", ".jsx": "jsx", ".mjs": "js", ".cjs": "js"}
#: Words that a chart gives a meaning of its own; fixed values.
CHART_WORDS = {"end", "graph", "subgraph", "flowchart", "direction", "class", "classDef", "click", "style", "linkStyle", "default"}
SAFE = re.compile(r"^[A-Za-z_][A-Za-z0-9_/]*$")
#: Files from which on a finding's places are summed up by folder, and folders that are named.
MANY_FILES, FOLDERS = 12, 3
MEMBERS, ALSO_AT, CHART_MODULES, CHART_EDGES = 8, 3, 20, 120


def tokens(text: str) -> int:
    """What a text costs about, one for its end included."""
    return -(-len(text) // 4) + 1


def percent(part: float, whole: float) -> str:
    return f"{100 * part / whole:.1f} %" if whole else "0 %"


def plural(n: int, word: str) -> str:
    return f"{n} {word}" if n == 1 else f"{n} {word}s"


def fence(text: str, path: str) -> str:
    """A block of code, its fence longer than any run of backticks in it."""
    ticks = "`" * max(3, 1 + max((len(m) for m in re.findall("`+", text)), default=0))
    return f"{ticks}{LANGUAGES.get(splitext(path)[1], '')}\n{text}\n{ticks}"


def chart_ids(names: list[str]) -> dict[str, str]:
    """An identifier for each name: the names themselves if all can be ones, or else slugs, numbered where they are the same."""
    if all(SAFE.match(n) and n not in CHART_WORDS for n in names):
        return {n: n for n in names}
    out: dict[str, str] = {}
    used: set[str] = set()
    for n in names:
        slug = re.sub(r"[^A-Za-z0-9]+", "_", n).strip("_") or "m"
        slug = f"m_{slug}" if slug in CHART_WORDS or slug[0].isdigit() else slug
        numbered, k = slug, 2
        while numbered in used:
            numbered, k = f"{slug}_{k}", k + 1
        used.add(numbered)
        out[n] = numbered
    return out


def chart_label(name: str) -> str:
    return name.replace('"', "#quot;")


def lifted(names: list[str]) -> tuple[str, list[str]]:
    """The folders that all names begin with, if there are two or more, and the names without them."""
    shared = dirname(names[0]).split("/") if names else []
    for n in names[1:]:
        own = dirname(n).split("/")
        k = 0
        while k < min(len(shared), len(own)) and shared[k] == own[k]:
            k += 1
        shared = shared[:k]
    prefix = "/".join(shared) + "/" if len([s for s in shared if s]) >= 2 else ""
    return prefix, [n[len(prefix) :] for n in names]


def chart(members: list[str], edges: list[dict]) -> str:
    """A flow chart of a tangle, or a list of its heaviest edges where it would be too large."""
    if len(members) > CHART_MODULES or len(edges) > CHART_EDGES:
        heavy = sorted(edges, key=lambda e: (-e["weight"], e["src"], e["dst"]))[:CHART_MODULES]
        return "\n".join(f"- {e['src']} → {e['dst']} ({e['weight']})" for e in heavy)
    ids = chart_ids(members)
    lines = ["```mermaid", "flowchart LR"]
    lines += [f'  {ids[m]}["{chart_label(m)}"]' for m in members if ids[m] != m]
    lines += [f"  {ids[e['src']]} {'-.->' if e['type_only'] else '-->'}|{e['weight']}| {ids[e['dst']]}" for e in edges]
    return "\n".join([*lines, "```"])


def places(locations: list[dict], most: int | None) -> str:
    """Files with their lines, up to ``most`` of them."""
    some = locations[:most] if most else locations
    text = ", ".join(f"{x['path']}:{','.join(map(str, x['lines']))}" for x in some)
    return text + (f" and {plural(len(locations) - len(some), 'more file')}" if len(some) < len(locations) else "")


def spread(locations: list[dict]) -> str:
    """How many files of a widely spread finding the folders hold."""
    if len(locations) <= MANY_FILES:
        return ""
    count: dict[str, int] = {}
    for x in locations:
        count[dirname(x["path"]) or "."] = count.get(dirname(x["path"]) or ".", 0) + 1
    order = sorted(count.items(), key=lambda x: (-x[1], x[0]))
    rest = sum(n for _, n in order[FOLDERS:])
    return "Spread: " + ", ".join(f"{d} ({n})" for d, n in order[:FOLDERS]) + (f", elsewhere ({rest})" if rest else "")


def duplication(row: dict, options: Options) -> str:
    out = [f"### {row['id']} — {row['kind']}, {plural(row['copies'], 'copy').replace('copys', 'copies')} in {plural(row['files'], 'file')}"]
    likeness = "equal" if row["level"] == "L0" else "equal but for names"
    out.append(f"{row['recoverable_lines']:g} lines can go ({row['lines_per_copy']:g} a copy, {likeness}, {plural(row['modules'], 'module')}, {row['tag']}).")
    out.append(f"At {places(row['locations'], options.max_locations)}.")
    out += [line for line in [spread(row["locations"])] if line]
    if also := row.get("also_at"):
        more = len(also) - ALSO_AT
        out.append("A part of it is also at " + ", ".join(f"{x['path']}:{x['line']}" for x in also[:ALSO_AT]) + (f" and {plural(more, 'more file')}" if more > 0 else "") + ".")
    if found := row.get("variations"):
        out.append("Copies differ in " + ", ".join(f"{v['label']} ({v['values']}{'+' if v['saturated'] else ''} values)" for v in found) + ".")
    if found := row.get("variants"):
        out.append("Similar: " + ", ".join(f"{v['id']} ({v['similarity']:.2f})" for v in found) + ".")
    around = row.get("context") or {}
    if around.get("shared_imports"):
        out.append("All of its files import " + ", ".join(x["target"] for x in around["shared_imports"]) + ".")
    if row["section"] != "tests" and (around.get("dependents") or around.get("barrel_dependents")):
        through = f", and {around['barrel_dependents']} more through {', '.join(around['barrels'])}" if around.get("barrel_dependents") else ""
        verb = "depends" if around["dependents"] == 1 else "depend"
        out.append(f"{plural(around['dependents'], 'file')} {verb} on them directly{through}.")
    if row.get("excerpt"):
        out.append(fence(row["excerpt"], row["locations"][0]["path"] if row["locations"] else ""))
    return "\n\n".join(out)


def cycle(row: dict) -> str:
    prefix, short = lifted(row["members"])
    named = dict(zip(row["members"], short, strict=True))
    edges = [e | {"src": named.get(e["src"], e["src"]), "dst": named.get(e["dst"], e["dst"])} for e in row["edges"]]
    some = short[:MEMBERS]
    rest = row["size"] - len(some)
    out = [f"### {row['id']} — {row['size']} modules", (f"Below {prefix}: " if prefix else "") + ", ".join(some) + (f" and {rest} more" if rest else "") + "."]
    if edges:
        out.append(chart(short, edges))
    found = row["file_cycles"]
    if found["crossing"] or found["within"]:
        out.append(f"Import cycles of files: {found['crossing']} across modules, {found['within']} within one. " + "; ".join(f"{x['members'][0]} and {x['size'] - 1} more" for x in found["examples"]) + ".")
    else:
        out.append("No file is in an import cycle: the modules depend on each other through different files.")
    if row["runtime_size"] < row["size"]:
        out.append(f"At run time {plural(row['runtime_size'], 'module')} hang together." if row["runtime_size"] else "At run time there is no cycle.")
    for d in row["dissolves"]:
        out.append(f"{d['src']} → {d['dst']} dissolves: {d['pass_through']} of {d['weight']} names only pass through, most of them from {d['origin_module']} ({d['origin']}).")
    if e := row["cut"]:
        left = f"{row['residual']} modules still hang together" if row["residual"] > 1 else "no cycle is left"
        out.append(f"Cut {e['src']} → {e['dst']} ({plural(e['weight'], 'name')} in {', '.join(e['files'])}{' and more' if e['n_files'] > len(e['files']) else ''}): {left}.")
    elif row["rejected"] is not None:
        out.append(f"No single cut helps: the best would leave {row['rejected']} of {row['size']}.")
    return "\n\n".join(out)


def head(report: dict) -> str:
    m, scope = report["metrics"], report["scope"]
    out = [
        "# Structure report",
        f"{plural(m['files'], 'file')}, {m['lines']} lines, {plural(m['modules'], 'module')} ({report['granularity']}). Configuration {report['config_hash']}.",
        f"Duplicated mass {m['duplicated_mass']} in {plural(m['findings'], 'finding')}, {100 * m['redundant_fraction']:.1f} % of the text is redundant. Propagation cost {m['propagation_cost']:.2f}, {plural(m['cycle_count'], 'tangle')}, the largest of {plural(m['largest_scc'], 'module')}.",
    ]
    if not scope["complete"]:
        out.append(f"> {scope['on_disk']} sources are on disk, and some of them are in no configuration: " + ", ".join(f"{g['owner']} ({g['missing']})" for g in scope["gaps"]) + ".")
    if report["excluded"]:
        out.append("Left out: " + ", ".join(f"{n} by {reason}" for reason, n in sorted(report["excluded"].items())) + ".")
    if bands := report["census"]["bands"]:
        order = [b for b in ("100+", "30-99", "10-29", "4-9", "1-3", "0") if b in bands]
        out.append("Findings in code by lines that can go: " + ", ".join(f"{b}: {bands[b]}" for b in order) + f". In a single file: {report['census']['single_file']}.")
    return "\n\n".join(out)


SECTIONS = (("Duplicated code", "code"), ("Duplicated types", "types"), ("Tangles", "cycles"), ("Duplicated tests", "tests"))


def blocks(report: dict, options: Options) -> dict[str, list[str]]:
    return {
        "code": [duplication(r, options) for r in report["duplication"] if r["section"] == "code"], "types": [duplication(r, options) for r in report["types"]],
        "cycles": [cycle(r) for r in report["cycles"]], "tests": [duplication(r, options) for r in report["duplication"] if r["section"] == "tests"],
    }


def within(parts: dict[str, list[str]], first: str, budget: int | None) -> dict[str, int]:
    """How many blocks of each section are shown: in order, until one does not fit what the head and a closing section leave."""
    if budget is None:
        return {k: len(v) for k, v in parts.items()}
    left = budget - tokens(first) - tokens(omitted({k: len(v) for k, v in parts.items()}, {k: 0 for k in parts}))
    out, full = {}, False
    for _, name in SECTIONS:
        out[name] = 0
        for block in parts[name]:
            left -= tokens(block)
            full = full or left < 0
            if full:
                break
            out[name] += 1
    return out


def omitted(there: dict[str, int], shown: dict[str, int]) -> str:
    missing = [f"{there[name] - shown[name]} of {title.lower()}" for title, name in SECTIONS if there[name] > shown[name]]
    return "## Left out for length\n\n" + ", ".join(missing) + "." if missing else ""


def render(report: dict, options: Options) -> str:
    parts, first = blocks(report, options), head(report)
    shown = within(parts, first, options.budget_tokens)
    out = [first]
    for title, name in SECTIONS:
        if name == "types" and options.types == "exclude":
            continue
        out.append(f"## {title}")
        out += parts[name][: shown[name]] or ["None." if not parts[name] else "See below."]
    out += [x for x in [omitted({k: len(v) for k, v in parts.items()}, shown)] if x]
    return "\n\n".join(out) + "\n"
