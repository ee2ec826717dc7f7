from quire.operators import edit
from quire.plans import conditions, identity


def test_group_transform(spark):
    shapes = spark.createDataFrame(
        [(1, "g", None, 10.0, 20.0, 100.0, 0.0, 0.5, 2.0), (1, "h", "g", 120.0, 5.0, 0.0, 0.0, 2.0, 1.0), (1, "s", "h", 3.0, 4.0, None, None, None, None), (1, "t", None, 7.0, 8.0, None, None, None, None)],
        "doc_id long, shape_id string, parent_id string, x double, y double, child_x double, child_y double, scale_x double, scale_y double")
    got = {r["shape_id"]: (r["x"], r["y"], r["scale_x"]) for r in conditions.group_transform(shapes).collect()}
    assert got == {"g": (10, 20, 0.5), "h": (20, 30, 1.0), "s": (23, 38, 1.0), "t": (7, 8, 1.0)}


def test_style_import(spark):
    schema = "doc_id long, style_id string, kind string, name string, ord int"
    source = spark.createDataFrame([(1, "A", "paragraph", "Alpha", 0), (1, "B", "paragraph", "Beta", 1), (1, "C", "paragraph", "Gamma", 2)], schema)
    target = spark.createDataFrame([(1, "X", "paragraph", "ALPHA", 0), (1, "B", "character", "Beta", 1), (1, "B_4", "paragraph", "other", 2)], schema)
    got = {r["style_id"]: (r["new_id"], r["copied"]) for r in identity.style_import_map(source, target).collect()}
    assert got == {"A": ("X", False), "B": ("B_5", True), "C": ("C", True)}


def test_replacement_over_runs():
    body = lambda x: b'<w:body xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main">' + x + b"</w:body>"
    data = body(b"<w:p><w:r><w:t>one t</w:t></w:r><w:r><w:b/><w:t>wo &amp; thr</w:t></w:r><w:r><w:t>ee</w:t></w:r></w:p><w:p><w:r><w:t>two</w:t></w:r></w:p>")
    new, n = edit.replace_across_runs(data, "two & three", "2 < 3")
    assert n == 1 and new == body(b"<w:p><w:r><w:t>one 2 &lt; 3</w:t></w:r><w:r><w:b/><w:t></w:t></w:r><w:r><w:t></w:t></w:r></w:p><w:p><w:r><w:t>two</w:t></w:r></w:p>")
    assert edit.replace_across_runs(data, "two", "2")[1] == 2
