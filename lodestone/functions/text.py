"""Column expressions over texts, paths, categories, queries and timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V

TOKEN = r"[\p{L}\p{N}_]+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def category_parts(category) -> Column:
    """Segments of a category, outer slashes stripped."""
    return F.split(F.regexp_replace(_c(category), "^/+|/+$", ""), "/")


def category_levels(category) -> list[Column]:
    """level1, level2, level3; null where there is no such segment."""
    p = category_parts(category)
    return [F.get(p, i).alias(f"level{i + 1}") for i in range(3)]


def category_closure(category) -> Column:
    """All prefixes of a category, shortest first."""
    p = category_parts(category)
    return F.transform(F.sequence(F.lit(1), F.size(p)), lambda n: F.array_join(F.slice(p, 1, n), "/"))


def normal_category(category) -> Column:
    return F.array_join(F.filter(F.split(_c(category), "/"), lambda x: x != ""), "/")


def tokens(text) -> Column:
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(TOKEN), F.lit(0))


def word_set(text) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(_c(text)), r"\s+"), lambda x: x != ""))


def overlap(a: Column, b: Column, by: str = "min") -> Column:
    """Shared words of two sets over the smaller ("min") or larger ("max") size; 0 for empty sets."""
    least = F.least if by == "min" else F.greatest
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / least(F.size(a), F.size(b))).otherwise(F.lit(0.0))


def _anchored(options: list[str], tail: str = "") -> str:
    return "(?i)^(" + "|".join(o + tail for o in options) + ")$"


def low_information(query) -> Column:
    """Reason for which a query carries no search intent; null if it does."""
    q = _c(query)
    text = F.regexp_replace(F.regexp_replace(q, "<[^>]+>.*?</[^>]+>", ""), r"^\s+|\s+$", "")
    return (
        F.when(q.isNull() | (q == ""), "empty")
        .when(text == "", "only_ide_tags")
        .when(text.rlike("(?i)" + V.INTERRUPTION), "interruption")
        .when(text.rlike(_anchored(V.ACKNOWLEDGEMENTS, r"[,.]?\s*")), "acknowledgement")
        .when(text.rlike(_anchored(V.FILLERS)), "filler")
        .when(text.rlike("(?i)" + V.SESSION_REFERENCE), "session_ref")
    )


def strip_blocks(text, kinds: list[str] | None = None) -> Column:
    out = _c(text)
    for kind in kinds or V.INJECTED_BLOCKS:
        out = F.regexp_replace(out, rf"(?s)<{kind}>.*?</{kind}>\s*", "")
    return out


def last_segments(path, n: int = 3) -> Column:
    parts = F.split(_c(path), "/")
    return F.when(F.size(parts) > n, F.array_join(F.slice(parts, -n, n), "/")).otherwise(_c(path))


def enriched_prompt(prompt, strip_ide: bool = True, with_file: bool = False, with_selection: bool = False, most: int = 300) -> Column:
    """Prompt without injected blocks, optionally led by the opened file and selection, cut to size."""
    p = _c(prompt)
    opened = F.trim(F.regexp_extract(p, r"(?s)<ide_opened_file>The user opened the file ([^<]+?) in the IDE[^<]*</ide_opened_file>", 1))
    chosen = F.substring(F.trim(F.regexp_extract(p, r"(?s)<ide_selection>[^:]+:\n(.*?)\n\nThis may or may not", 1)), 1, 100)
    out = strip_blocks(p, V.INJECTED_BLOCKS if strip_ide else V.INJECTED_BLOCKS[2:])
    out = F.regexp_replace(out, r"^\s+|\s+$", "")
    if with_file:
        out = F.when(opened != "", F.concat(F.lit("[file: "), last_segments(opened), F.lit("] "), out)).otherwise(out)
    if with_selection:
        out = F.when(chosen != "", F.concat(F.lit("[selection: "), chosen, F.lit("] "), out)).otherwise(out)
    return F.substring(out, 1, most)


def _lookup(key: Column, table: dict[str, str], other: Column) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), other)


def tool_query(tool, params: dict[str, Column]) -> Column:
    """Search words of a tool call; null where the call says too little. params: columns by name."""
    t = _c(tool)
    get = lambda k: F.coalesce(params.get(k, F.lit(None).cast("string")), F.lit(""))
    command = F.regexp_replace(get("command"), r"^\s+|\s+$", "")
    w = F.split(command, r"\s+")
    word = lambda i: F.coalesce(F.get(w, i), F.lit(""))
    head = F.array_join(F.slice(w, 1, 3), " ")
    base, sub = word(0), word(1)
    two = F.array_join(F.slice(w, 2, 2), " ")
    bash = (
        F.when(command == "", F.lit(None).cast("string"))
        .when(base == "git", _lookup(sub, V.GIT_QUERIES, F.concat(F.lit("git "), sub)))
        .when(base == "gh", _lookup(two, V.GH_QUERIES, F.concat(F.lit("github "), two)))
        .when(base.isin(V.TEST_COMMANDS), F.concat(F.lit("testing "), head))
        .when(base.isin(V.SCRIPT_COMMANDS) & sub.isin("test", "t"), F.lit("testing npm test"))
        .when(base.isin(V.SCRIPT_COMMANDS) & (sub == "run") & (F.size(w) > 2), F.concat(word(2), F.lit(" script")))
        .when(base.isin(V.SCRIPT_COMMANDS), F.concat(base, F.lit(" "), sub))
        .when(base.isin(V.PYTHON_COMMANDS), F.concat(F.lit("python package "), two))
        .otherwise(head)
    )
    path = get("file_path")
    name = F.element_at(F.split(path, "/"), -1)
    ext = F.regexp_extract(name, r"^.+(\.[^.]*)$", 1)
    context = (
        F.when(name.contains(".cy."), "cypress testing")
        .when(name.contains(".stories."), "storybook stories")
        .when(name.contains(".test.") | name.contains(".spec."), "unit testing")
        .otherwise(_lookup(ext, V.EDIT_CONTEXT, F.lit("")))
    )
    none = F.lit(None).cast("string")
    edit = F.when(path != "", F.trim(F.concat(F.lit("editing "), context, F.lit(" "), last_segments(path)))).otherwise(none)
    write = F.when(path != "", F.concat(F.lit("writing "), name, F.lit(" "), last_segments(path))).otherwise(none)
    skill = F.when(get("skill") != "", F.concat(get("skill"), F.lit(" skill"))).otherwise(none)
    task = F.when(get("description") != "", get("description")).otherwise(none)
    given = [F.when(get(k) != "", F.substring(get(k), 1, 100)) for k in V.GENERIC_PARAMETERS]
    rest = F.concat_ws(" ", *given)
    generic = F.when(rest != "", F.concat(t, F.lit(" "), rest)).otherwise(none)
    return F.when(t == "Bash", bash).when(t == "Edit", edit).when(t == "Write", write).when(t == "Skill", skill).when(t == "Task", task).otherwise(generic)


def with_narration(narration, query) -> Column:
    return F.nullif(F.concat_ws(" ", F.nullif(_c(narration), F.lit("")), F.nullif(_c(query), F.lit(""))), F.lit(""))


def post_tool_query(narration, tool, params: dict[str, Column], most: int = 200) -> Column:
    get = lambda k: F.nullif(params.get(k, F.lit(None).cast("string")), F.lit(""))
    context = F.when(_c(tool) == "Read", last_segments(get("file_path"))).when(_c(tool).isin("Grep", "Glob"), get("pattern"))
    return with_narration(F.substring(_c(narration), 1, most), context)


def enrichment(strategy: str, prompt, prior=None, file=None) -> Column:
    """Query text under a named strategy: raw, strip, strip+file, strip+prior or full."""
    bare = enriched_prompt(prompt, most=1 << 30)
    short = F.size(F.filter(F.split(bare, r"\s+"), lambda x: x != "")) < 8
    lead = F.when(short & _c(prior).isNotNull(), F.concat(_c(prior), F.lit(" "))).otherwise(F.lit("")) if prior is not None else F.lit("")
    shown = F.when(_c(file).isNotNull(), F.concat(F.lit("[file: "), last_segments(file), F.lit("] "))).otherwise(F.lit("")) if file is not None else F.lit("")
    return {"raw": _c(prompt), "strip": bare, "strip+file": F.concat(shown, bare), "strip+prior": F.concat(lead, bare), "full": F.concat(shown, lead, bare)}[strategy]


def inferred_servers(text, signals=None) -> Column:
    """Servers that a text (or project signals) calls for, sorted; null if none."""
    found = F.array().cast("array<string>")
    for keyword, servers in V.KEYWORD_SERVERS.items():
        hit = F.lower(_c(text)).contains(keyword)
        if signals is not None:
            hit = hit | F.exists(_c(signals), lambda s, k=keyword: F.lower(s).contains(k) | F.lit(k).contains(F.lower(s)))
        found = F.array_union(found, F.when(hit, F.array(*map(F.lit, servers))).otherwise(F.array().cast("array<string>")))
    return F.when(F.size(found) > 0, F.array_sort(found))


def meets_prerequisites(prereq, os, cwd, servers) -> Column:
    """Structural prerequisites (struct of os, paths, mcp_servers arrays) against an environment.

    Repositories and tags are no gate; a null struct passes.
    """
    p = _c(prereq)
    at = _c(cwd)
    system = p["os"].isNull() | (F.size(p["os"]) == 0) | F.array_contains(p["os"], _c(os))
    place = p["paths"].isNull() | (F.size(p["paths"]) == 0) | F.exists(p["paths"], lambda x: (at == x) | at.startswith(F.concat(F.regexp_replace(x, "/+$", ""), F.lit("/"))))
    tools = p["mcp_servers"].isNull() | (F.size(F.array_except(p["mcp_servers"], _c(servers))) == 0)
    return p.isNull() | (F.coalesce(system, F.lit(False)) & F.coalesce(place, F.lit(False)) & F.coalesce(tools, F.lit(False)))


def tag_prerequisites_met() -> Column:
    """Tags gate nothing any more; the predicate stays for callers of the old form."""
    return F.lit(True)


def in_scope(repo, disabled: list[str], everything_off: bool = False) -> Column:
    return F.lit(not everything_off) & ~F.coalesce(_c(repo).isin(disabled), F.lit(False)) if disabled else F.lit(not everything_off)


def attribution(similarity, floor: float = 0.20, ceiling: float = 1.0) -> Column:
    """Weight of a tag by similarity: 0 up to floor, then a square rise to 1 at ceiling."""
    s = _c(similarity)
    x = (s - floor) / (ceiling - floor)
    return F.when(s <= floor, 0.0).otherwise(F.least(x * x, F.lit(1.0)))


def recency(refreshed, created, now, c: float = 0.003) -> Column:
    """1 / (1 + c * age in days); 1 without dates."""
    at = F.coalesce(_c(refreshed), _c(created))
    age = (F.unix_micros(_c(now)) - F.unix_micros(at)) / F.lit(86400e6)
    return F.when(at.isNull(), 1.0).otherwise(1.0 / (1.0 + c * F.greatest(age, F.lit(0.0))))


def anchors(n: int, ceiling_factor: float = 1.0, floor_factor: float = 1.0) -> tuple[int, float, float]:
    """k, ceiling and floor of rank fusion over n items; the plain ones if the factors cross them."""
    k = max(1, n // 5)
    top, low = 2 / (k + 1), 1 / (k + 10)
    hi, lo = top * ceiling_factor, low * floor_factor
    return (k, hi, lo) if hi > lo else (k, top, low)


def repo_of_remote(url) -> Column:
    return F.nullif(F.regexp_extract(_c(url), r"[/:]([^/]+?)(?:\.git)?$", 1), F.lit(""))


def excerpt(text, most: int = 6000, gap: str = "\n\n[...]\n\n") -> Column:
    """Head and tail of a text that is too long."""
    t = _c(text)
    half = (most - len(gap)) // 2
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, half), F.lit(gap), F.right(t, F.lit(half)))).otherwise(t)


def strip_frontmatter(text) -> Column:
    return F.regexp_replace(_c(text), r"(?s)\A---\n.*?\n---\n*", "")


def capped_score(score, found) -> Column:
    """Scores above 1 need evidence."""
    return F.when((_c(score) > 1) & (F.coalesce(F.upper(F.trim(_c(found))), F.lit("")).isin("", "NO")), 1).otherwise(_c(score))


def bucket(score, edge: float = 0.1) -> Column:
    return F.when(_c(score) > edge, "pos").when(_c(score) < -edge, "neg").otherwise("neu")


def injected_block(lines, title: str) -> Column:
    return F.concat_ws("\n", F.lit(title), F.array_join(F.transform(_c(lines), lambda x: F.concat(F.lit("- "), x)), "\n"))


def merged_json(text, schema: str) -> Column:
    """JSON with null for malformed input."""
    return F.from_json(_c(text), schema)


def cosine(a, b) -> Column:
    """Cosine of two float arrays with 1e-10 added to each norm."""
    zero = F.lit(0.0)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), zero, lambda s, v: s + v)
    x, y = _c(a), _c(b)
    return dot(x, y) / ((F.sqrt(dot(x, x)) + 1e-10) * (F.sqrt(dot(y, y)) + 1e-10))
