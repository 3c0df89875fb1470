from spectrail import __main__ as main


def test_folder(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    names = ["2-phenyl-4-methylpropan-1-one (1a)", "3-benzyl-5-chlorobenzene-1-ol (2b)"]
    body = "\n".join(f"{n}\nThe compound was made by the general way that is given above in the text of the part\n1H NMR (400 MHz, CDCl3): 7.{i}2 (s, 1H).\nIt was used as it is in the next step without any more work on it at all" for i, n in enumerate(names))
    (folder / "a.txt").write_text(body)
    (folder / "b.txt").write_bytes(b"\xff\xfe\xff")
    main.main([str(folder), str(tmp_path / "out"), "--suffix", "txt"])
    assert spark.read.parquet(str(tmp_path / "out/errors")).count() == 1
    assert {r.test_type for r in spark.read.parquet(str(tmp_path / "out/tests")).collect()} <= {"1H NMR"}
