"""Column functions against plain statements of their rules (FIXTURES.md, part C)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.workspace import workspace_tags


def one(spark, **cols):
    return spark.range(1).select(*(v.alias(k) for k, v in cols.items())).first()


def values(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_categories(spark):
    rows = [("/a/b/c/d",), ("x",), ("a//b/",)]
    df = spark.createDataFrame(rows, "c string")
    assert [tuple(r) for r in df.select(*T.category_levels("c")).collect()][:2] == [("a", "b", "c"), ("x", None, None)]
    assert df.select(T.category_closure("c")).first()[0] == ["a", "a/b", "a/b/c", "a/b/c/d"]
    assert values(spark, rows, "c string", T.normal_category("c")) == ["a/b/c/d", "x", "a/b"]


def test_tokens_are_unicode(spark):
    assert values(spark, [("Étion_1 dans, x-y",)], "t string", T.tokens("t")) == [["étion_1", "dans", "x", "y"]]


@pytest.mark.parametrize("query,reason", [
    ("yes", "acknowledgement"), ("Thank you.", "acknowledgement"), ("let's do that", "acknowledgement"), ("[Request interrupted by user]", "interruption"), ("still running?", "filler"),
    ("can we consider 039 done?", "session_ref"), ("", "empty"), (None, "empty"), ("<a>x</a>", "only_ide_tags"), ("yes please add the index", None), ("fix the git hooks", None), ("I don't know", "filler"),
])
def test_low_information(spark, query, reason):
    assert values(spark, [(query,)], "q string", T.low_information("q")) == [reason]


def test_prompt_enrichment(spark):
    p = "<ide_opened_file>The user opened the file /a/b/c/d.py in the IDE. More</ide_opened_file>\n fix it <system-reminder>a\nb</system-reminder> "
    assert values(spark, [(p,)], "p string", T.enriched_prompt("p")) == ["fix it"]
    assert values(spark, [(p,)], "p string", T.enriched_prompt("p", with_file=True)) == ["[file: b/c/d.py] fix it"]
    assert values(spark, [("x" * 400,)], "p string", F.length(T.enriched_prompt("p"))) == [300]
    s = "<ide_selection>The user selected lines:\nabc\n\nThis may or may not matter</ide_selection> why"
    assert values(spark, [(s,)], "p string", T.enriched_prompt("p", with_selection=True)) == ["[selection: abc] why"]


@pytest.mark.parametrize("tool,params,want", [
    ("Bash", {"command": "git commit -m x"}, "git commit conventions"), ("Bash", {"command": "git stash"}, "git stash"), ("Bash", {"command": "gh pr create --fill"}, "pull request create description template"),
    ("Bash", {"command": "gh run list"}, "github run list"), ("Bash", {"command": "pytest -x tests more"}, "testing pytest -x tests"), ("Bash", {"command": "npm test"}, "testing npm test"),
    ("Bash", {"command": "npm run build"}, "build script"), ("Bash", {"command": "yarn add"}, "yarn add"), ("Bash", {"command": "pip install x"}, "python package install x"), ("Bash", {"command": "  "}, None),
    ("Bash", {"command": "ls -la /tmp /x"}, "ls -la /tmp"), ("Edit", {"file_path": "/a/b/c/x.tsx"}, "editing react typescript component b/c/x.tsx"), ("Edit", {"file_path": "a.cy.ts"}, "editing cypress testing a.cy.ts"),
    ("Edit", {"file_path": "/r/a.test.js"}, "editing unit testing /r/a.test.js"), ("Write", {"file_path": "/a/b/c/d.py"}, "writing d.py b/c/d.py"), ("Skill", {"skill": "pdf"}, "pdf skill"), ("Skill", {}, None),
    ("Task", {"description": "look"}, "look"), ("Grep", {"pattern": "foo", "path": "src"}, "Grep src foo"), ("Glob", {}, None),
])
def test_tool_queries(spark, tool, params, want):
    assert one(spark, q=T.tool_query(F.lit(tool), {k: F.lit(v) for k, v in params.items()})).q == want


def test_narration_and_post_tool(spark):
    assert one(spark, q=T.post_tool_query(F.lit("n" * 250), F.lit("Read"), {"file_path": F.lit("/a/b/c/d")})).q == "n" * 200 + " b/c/d"
    assert one(spark, q=T.post_tool_query(F.lit(None).cast("string"), F.lit("Bash"), {})).q is None
    assert one(spark, q=T.with_narration(F.lit("why"), F.lit("what"))).q == "why what"


def test_enrichment_strategies(spark):
    e = lambda s: one(spark, q=T.enrichment(s, F.lit("<ide_selection>x</ide_selection> do it"), F.lit("before"), F.lit("/a/b/c/d"))).q
    assert [e(s) for s in ("strip", "strip+file", "strip+prior", "full")] == ["do it", "[file: b/c/d] do it", "before do it", "[file: b/c/d] before do it"]


@pytest.mark.parametrize("sim,want", [(0.20, 0.0), (0.40, 0.0625), (0.80, 0.5625), (0.95, 0.87890625), (1.2, 1.0)])
def test_attribution(spark, sim, want):
    assert one(spark, w=T.attribution(F.lit(sim))).w == pytest.approx(want)


def test_recency(spark):
    now = F.lit(dt.datetime(2024, 7, 19)).cast("timestamp")
    then = F.lit(dt.datetime(2024, 1, 1)).cast("timestamp")
    none = F.lit(None).cast("timestamp")
    assert one(spark, f=T.recency(none, then, now)).f == pytest.approx(0.625)
    assert one(spark, f=T.recency(none, none, now)).f == 1.0


def test_anchors():
    assert T.anchors(50) == (10, 2 / 11, 1 / 20)
    assert T.anchors(50, 0.1, 10) == T.anchors(50)
    assert T.anchors(3)[0] == 1


@pytest.mark.parametrize("cwd,ok", [("/w/acme/x", True), ("/w/acme", True), ("/w/acme2", False)])
def test_path_prerequisites(spark, cwd, ok):
    p = F.struct(F.array().cast("array<string>").alias("os"), F.array(F.lit("/w/acme")).alias("paths"), F.lit(None).cast("array<string>").alias("mcp_servers"))
    assert one(spark, x=T.meets_prerequisites(p, F.lit("linux"), F.lit(cwd), F.array())).x is ok


def test_server_and_system_prerequisites(spark):
    none = F.lit(None).cast("array<string>")
    p = F.struct(F.array(F.lit("darwin")).alias("os"), none.alias("paths"), F.array(F.lit("figma")).alias("mcp_servers"))
    assert one(spark, x=T.meets_prerequisites(p, F.lit("darwin"), F.lit("/"), F.array(F.lit("figma")))).x
    assert not one(spark, x=T.meets_prerequisites(p, F.lit("darwin"), F.lit("/"), F.array(F.lit("other")))).x
    assert not one(spark, x=T.meets_prerequisites(p, F.lit("linux"), F.lit("/"), F.array(F.lit("figma")))).x
    assert one(spark, x=T.inferred_servers(F.lit("use the Figma MCP now"))).x == ["figma"]


def test_workspace_tags(spark):
    facts = [("w", "remote", "git@github.com:acme/App.git"), ("w", "file", "tsconfig.json"), ("w", "dep", "react-dom"), ("w", "dep", "next-auth"), ("w", "gem", "rspec"), ("w", "dir", "apps/"), ("v", "file", "package.json")]
    got = {(r.workspace, r.tag) for r in workspace_tags(spark.createDataFrame(facts, "workspace string, kind string, value string")).collect()}
    assert got == {("w", t) for t in ("github", "repo:app", "typescript", "react", "frontend", "nextjs", "rspec", "testing", "monorepo")}


def test_small_expressions(spark):
    r = one(spark, e=T.excerpt(F.lit("a" * 5000 + "b" * 5000), 100), c=T.capped_score(F.lit(3), F.lit("no")), d=T.capped_score(F.lit(3), F.lit("quote")), b=T.bucket(F.lit(-0.2)), f=T.strip_frontmatter(F.lit("---\nx: 1\n---\nbody")), o=T.overlap(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"))), s=T.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))))
    assert len(r.e) == 45 * 2 + 9 and r.e.startswith("a") and r.e.endswith("b")
    assert (r.c, r.d, r.b, r.f, r.o) == (1, 3, "neg", "body", 1.0)
    assert r.s == pytest.approx(0.5**0.5)
