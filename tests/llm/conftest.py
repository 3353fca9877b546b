import random

import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "palabra " * 30_000


@pytest.fixture
def awkward(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows, columns with clashing names."""
    rows = [
        (1, "The same text here, twice over.", "en", "a", 31),
        (2, "The same text here, twice over.", "en", "a", 31),
        (2, "The same text here, twice over.", "en", "a", 31),
        (3, None, None, None, None),
        (4, "", "en", "b", 0),
        (5, LONG, "es", "b", len(LONG)),
        (None, "Ein Satz ohne Kennung, und noch einer.", "de", None, 1),
        (6, "1234 !!! \n\t ***", "fr", "c", 1),
        (7, "Größe: 日本語 😀\u0000é tail", "de", "c", 1),
    ]
    plain = spark.createDataFrame(rows, DOCUMENT)
    names = ["size", "shard", "slot", "spans", "fp", "id", "kept", "copies", "score", "range", "label", "digest", "mark", "place", "hi", "lo"]
    return plain.selectExpr("*", *[f"'clash' AS {n}" for n in names])


@pytest.fixture
def no_rows(spark):
    return spark.createDataFrame([], DOCUMENT)


@pytest.fixture
def corpus(spark):
    """A small corpus with copies, near copies and shared passages."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)] + ["é", "Straße", "de", "the"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, base, rows = text(120), text(200), []
    for i in range(120):
        kind = i % 6
        body = text(rng.randint(1, 150))
        if kind == 1:
            body = rows[0][1]
        elif kind == 2:
            near = base.split()
            near[rng.randrange(len(near))] = "edit"
            body = " ".join(near)
        elif kind == 3:
            body = f"{body} {shared} {text(20)}"
        rows.append((i, body, "en" if i % 3 else "de", f"s{i % 4}" if i % 9 else "s0", len(body)))
    return spark.createDataFrame(rows, DOCUMENT)


@pytest.fixture
def folder(tmp_path):
    """Writes a table as sf_dir/documents.parquet (or another name) and returns sf_dir."""

    def write(df, name="documents"):
        df.write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write
