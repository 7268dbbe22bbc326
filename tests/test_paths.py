import pytest
from pyspark.sql import functions as F

from docloom.plans import Path, VariantResolver, filter_path, index_path
from docloom.plans.paths import ANY, PathError, local_path, namespace_of, normalize_path


@pytest.mark.parametrize(
    "text,want",
    [("a.b", ("a", "b")), ("a[0]", ("a", 0)), ("a[0].b", ("a", 0, "b")), ("./a", ("a",)), ("a..b", ("a", "b")), ("$.a", ("$", "a")), ("$ns.a", ("$ns", "a")), ("a[-1]", ("a", -1)), ("a[1][2]", ("a", 1, 2)), ("", ())],
)
def test_filter_paths(text, want):
    assert filter_path(text).segments == want


@pytest.mark.parametrize("text", ["a[", "a[]", "a[x]", "a[0]b"])
def test_bad_filter_paths(text):
    with pytest.raises(PathError):
        filter_path(text)


def test_index_dialect():
    assert [normalize_path(x) for x in ("a.b", "$g.a", "$.a")] == ["$_current.a.b", "$g.a", "$_current.a"]
    assert [local_path(x) for x in ("a.b", "$g.a", "$.a")] == ["$.a.b", "$.a", "$.a"]
    assert [namespace_of(x) for x in ("$gene.x", "a.b", "$.a")] == ["gene", "_current", "_current"]
    assert index_path("$g.a[0]['k.l'].*").segments == ("a", 0, "k.l", ANY)
    with pytest.raises(PathError):
        index_path("a[[")


def test_variant_paths():
    assert Path(("a", 0, 'q"x')).variant_path() == "$[\"a\"][0]['q\"x']"
    assert Path((-1,)).variant_path() is None and Path((ANY,)).variant_path() is None


def test_wildcards_find_all(spark):
    df = spark.createDataFrame([('{"a":[{"b":1},{"b":2}]}',)], "j string").select(F.parse_json("j").alias("doc"))
    v = VariantResolver(parse=index_path).value("a[*].b")
    assert df.filter(v.contains(2)[0]).count() == 1


def test_keys_with_quotes(spark):
    """Keys with one kind of quote, with both, and behind a wildcard."""
    text = r"""{"both'\"q":{"x":[5]},"it's":[{"o'k":1},{"o'k":2}],"w?":[{"n":3}]}"""
    df = spark.createDataFrame([(text,), ('{"other":1}',), ("[1]",)], "j string").select(F.parse_json("j").alias("doc"))
    seen = lambda r, path, v: df.filter(r.value(path).eq(v)[0]).count()
    own, index = VariantResolver(), VariantResolver(parse=index_path)
    assert seen(own, "both'\"q.x[0]", 5) == 1 and seen(own, "both'\"q.x[0]", 6) == 0 and seen(own, "both'\"q.x", None) == 2
    assert seen(own, "it's[1].o'k", 2) == 1 and Path(("it's",)).variant_path() == '$["it\'s"]'
    assert df.filter(index.value("it's[*].o'k").contains(2)[0]).count() == 1 and seen(index, "w?[*].n", 3) == 1
