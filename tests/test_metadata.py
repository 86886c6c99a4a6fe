"""Metadata documents, stacks and names on small fixtures."""

from pyspark.sql import functions as F

from pointweave.sources import metadata


def image(name, objective, size, at):
    plane = "" if at is None else f'<Plane PositionX="{at}" PositionY="1"/><Plane PositionX="99" PositionY="99"/>'
    return f'<Image Name="{name}"><ObjectiveSettings ID="{objective}"/><Pixels SizeX="{size}" SizeY="5" SizeZ="1" SizeC="3" SizeT="1" PhysicalSizeX="0.5" PhysicalSizeY="0.25">{plane}</Pixels></Image>'  # noqa: E501


def test_stacks_of_a_slide(spark):
    """Levels of two scenes come mixed; images without plane or with an unknown objective are left out."""
    xml = (
        '<OME xmlns="x"><Instrument><Objective ID="o" NominalMagnification="10"/><Objective ID="o" NominalMagnification="20"/></Instrument>'
        + image("a", "o", 800, 4) + image("b", "o", 600, 2) + image("c", "o", 200, 4) + image("d", "o", 9, None) + image("e", "p", 9, 4)
        + image("f", "o", 150, 2) + "</OME>"
    )
    docs = spark.createDataFrame([(1, xml), (2, None), (3, "no xml"), (4, "<OME/>")], "image_id int, xml string")
    got = metadata.pyramid_stacks(metadata.ome_images(docs)).orderBy("idx").collect()
    rows = [(r["image_id"], r["idx"], r["name"], r["scene"], r["level"], r["magnification"]) for r in got]
    assert rows == [(1, 0, "a", 0, 0, 20.0), (1, 1, "b", 1, 0, 20.0), (1, 2, "c", 0, 1, 5.0), (1, 5, "f", 1, 1, 5.0)]
    assert (got[0]["pixel_x"], got[0]["pixel_y"], got[0]["position_x"], got[0]["size_c"]) == (0.5, 0.25, 4.0, 3)


def test_documents_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", [1.5, 2.0]), (2, "b}\n{", None)], "k int, name string, v array<double>")
    metadata.write_documents(df.coalesce(1), str(tmp_path / "lines"))
    read = lambda p: sorted(tuple(r) for r in metadata.read_documents(spark, str(tmp_path / p), "k int, name string, v array<double>").collect())
    assert read("lines") == [(1, "a", [1.5, 2.0]), (2, "b}\n{", None)]
    (tmp_path / "one.json").write_text('{\n  "k": 7,\n  "name": "x"\n}\n')
    (tmp_path / "list.json").write_text('[{"k": 8}, {"k": 9}]')
    assert read("one.json") == [(7, "x", None)] and [r[0] for r in read("list.json")] == [8, 9]


def test_lists_and_names(spark):
    df = spark.createDataFrame([("['a b', \"c\"]", "s__R3_C14_TS9_OL0.jpg"), ("[]", "plain.jpg"), ("x", None), (None, "")], "t string, n string")
    got = df.select(metadata.literal_list("t"), metadata.swapped_tile_name("n")).collect()
    assert [tuple(r) for r in got] == [(["a b", "c"], "s__R14_C3_TS9_OL0.jpg"), ([], "plain.jpg"), (None, None), (None, "")]
    files = df.select(F.col("n").alias("path")).where("path > ''")
    assert [r["path"] for r in metadata.first_files(files, 1).collect()] == ["plain.jpg"]
