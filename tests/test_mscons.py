"""The split MSCONS reader against a plain loop over whole texts."""

import random

from pyspark.sql import functions as F

from loadweave.sources import mscons


def whole(text):
    """Rows of mscons.SCHEMA but file, from one text in one loop."""
    obis, start, end, held, out, before_qty = None, None, None, [], [], False

    def flush():
        for k, (value, unit, qualifier) in enumerate(held):
            out.append((*(start or (None, None)), *(end or (None, None)), k, len(held), value, unit, obis, qualifier, qualifier in mscons.KNOWN))

    for seg in mscons.segments(text):
        tag = seg[0][0]
        if tag in ("PIA", "LIN"):
            flush()
            start, end, held = None, None, []
            if tag == "PIA" and len(seg) > 2:
                obis = ":".join(seg[2][:2]).rstrip(":")
        elif tag == "QTY":
            if held and start and end and not before_qty:
                flush()
                start, end, held = None, None, []
            if not held:
                before_qty = start is not None
            try:
                held.append((float(seg[1][1]), seg[1][2] if len(seg[1]) > 2 else None, seg[1][0]))
            except (IndexError, ValueError):
                continue
        elif tag == "DTM" and len(seg) > 1 and len(seg[1]) > 1:
            at = (seg[1][1], seg[1][2] if len(seg[1]) > 2 else "203")
            if seg[1][0] == "163":
                if held and before_qty:
                    flush()
                    held, end = [], None
                start = at
            elif seg[1][0] == "164":
                end = at
    flush()
    return out


def message(rng, n, signs=":+.? '"):
    """Segments in any order: bad amounts, codes left out, end signs and release characters quoted, lines broken anywhere."""
    c, e, _, r, _, end = signs
    out = []
    for _ in range(n):
        out.append(rng.choice([
            f"LIN{e}{rng.randrange(9)}", "LIN", f"PIA{e}5{e}1-{rng.randrange(3)}{r}{c}1.8.{rng.randrange(3)}{c}SRW", f"PIA{e}5", f"PIA{e}5{e}7{e}it{r}{end}s",
            *[f"QTY{e}{rng.choice(['220', '67', '9'])}{c}{rng.randrange(999)}{rng.choice([f'{c}KWH', ''])}" for _ in range(5)], f"QTY{e}220{c}none", f"QTY{e}220", "QTY",
            *[f"DTM{e}{k}{c}2024060{rng.randrange(1, 9)}{rng.randrange(10, 24)}00{rng.choice([f'{r}+00{c}303', f'{c}203', ''])}" for k in (163, 164) * 3],
            f"FTX{e}a{r}{end}QTY{e}220{c}5", f"FTX{e}b{r}{r}", f"FTX{r}{end}{r}{end}LIN{e}1", f"LOC{e}172", f"LINX{e}1", "",
        ]))
    text = end.join(out) + rng.choice(["", end])
    return "".join(x + (rng.choice(["\n", "\r\n"]) if rng.random() < 0.02 and x != r else "") for x in text)


def read(spark, path):
    x = mscons.read_values(spark, str(path))
    rows = x.withColumn("file", F.regexp_extract("file", "([^/]+)$", 1)).collect()
    return sorted(map(tuple, rows), key=repr)


def test_splits_and_whole_texts_agree(spark, tmp_path):
    rng = random.Random(5)
    texts = {f"m{k}.edi": message(rng, 1500 if k < 3 else rng.randrange(60)) for k in range(20)}
    texts["own.edi"] = "UNA-*.! ~" + message(rng, 800, "-*.! ~")
    texts["unquoted.edi"] = "UNA:+.  ~" + message(rng, 100, ":+.% ~").replace("%", "")
    texts["usual.edi"] = "UNA:+.? '" + message(rng, 300)
    texts |= {"empty.edi": "", "signs.edi": "UNA:+.? '", "none.edi": "no segments 0UNA;+.? ~here"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    want = sorted(((name, *row) for name, text in texts.items() for row in whole(text)), key=repr)
    assert len(want) > 1000
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (700, 5000):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert spark.read.text(str(tmp_path / "m0.edi")).rdd.getNumPartitions() > 2
            assert read(spark, tmp_path) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_only_empty_files(spark, tmp_path):
    (tmp_path / "a.edi").write_bytes(b"")
    assert mscons.read_mscons(spark, str(tmp_path)).count() == 0
