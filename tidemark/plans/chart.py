"""The bump chart as a drawing: a line per unbroken stretch of a term, a mark by how often it appears, labels at both ends."""

from __future__ import annotations

from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import ranks

#: Snapshots that a drawing has at most; a longer run is drawn in parts.
POINTS = 2_000

_STEP, _ROW, _LEFT, _TOP = 70, 36, 70, 50
_COLOURS = 20
_MARKS = {
    1: ("once", '<circle cx="{x}" cy="{y}" r="5"/>'),
    2: ("twice", '<rect x="{x4}" y="{y4}" width="9" height="9"/>'),
    3: ("three times", '<path d="M{x} {y6}l6 6-6 6-6-6z"/>'),
    4: ("four times", '<path d="M{x} {y6}l6 11h-12z"/>'),
    5: ("five times or more", '<path d="M{x} {y6}l2 4 4 1-3 3 1 5-4-2-4 2 1-5-3-3 4-1z"/>'),
}


def _mark(kind: int, x: float, y: float) -> str:
    return _MARKS[kind][1].format(x=x, y=y, x4=x - 4.5, y4=y - 4.5, y6=y - 6)


def bump_chart(ranked: DataFrame, interval: int, title: str = "Bursting terms over time") -> str:
    """ranked: t, term, rank. An SVG document; an empty frame of axes without snapshots."""
    drawn = ranked.where(F.col("rank") <= ranks.DRAWN)
    times = [r.t for r in drawn.select("t").distinct().orderBy("t").limit(POINTS + 1).collect()]
    if len(times) > POINTS:
        raise ValueError(f"a chart has at most {POINTS} snapshots; draw a part of t at a time")
    marks = {r.term: r.marker for r in ranks.markers(ranked).join(drawn.select("term").distinct(), "term").collect()}
    at = {(r.term, r.t): r.rank for r in drawn.select("term", "t", F.col("rank").alias("rank")).collect()}
    lines = [(r.term, r.first_t, r.last_t) for r in ranks.segments(ranked, interval).orderBy("term", "first_t").collect()]
    place = {t: _LEFT + _STEP * (t // interval - times[0] // interval) for t in times}
    low, width = _TOP + _ROW * ranks.DRAWN, _LEFT + _STEP + max(place.values(), default=0)
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{low + 70}" font-family="sans-serif" font-size="11">', f'<text x="{_LEFT}" y="20" font-size="14">{escape(title)}</text>']
    out += [f'<text x="{_LEFT - 40}" y="{_TOP + _ROW * (k - 1) + 4}">{k}</text>' for k in range(1, ranks.DRAWN + 1)]
    out += [f'<text x="{x}" y="{low + 10}" text-anchor="middle">{t}</text>' for t, x in place.items()]
    hue = {term: 360 * (k % _COLOURS) // _COLOURS for k, term in enumerate(sorted(marks))}
    for term, first, last in lines:
        points = [(place[t], _TOP + _ROW * (at[term, t] - 1)) for t in times if first <= t <= last]
        colour = f"hsl({hue[term]},65%,42%)"
        out.append(f'<g fill="{colour}"><polyline points="{" ".join(f"{x},{y}" for x, y in points)}" fill="none" stroke="{colour}" stroke-width="2"/>')
        out += [_mark(marks[term], x, y) for x, y in points]
        out += [f'<text x="{x}" y="{y - 8}" text-anchor="middle">{escape(term)}</text>' for x, y in dict.fromkeys((points[0], points[-1]))]
        out.append("</g>")
    out += [f'<g>{_mark(k, _LEFT + 150 * (k - 1), low + 40)}<text x="{_LEFT + 150 * (k - 1) + 12}" y="{low + 44}">{what}</text></g>' for k, (what, _) in _MARKS.items()]
    return "\n".join([*out, "</svg>"])


def save(spark: SparkSession, drawing: str, path: str) -> None:
    """Writes the drawing to a file of any file system that Spark knows."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    file = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    file.write(bytearray(drawing.encode()))
    file.close()
