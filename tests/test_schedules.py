from __future__ import annotations

import random
import re

from spanwright.functions.marks import MARK_PATTERNS
from spanwright.operators import schedules as S

WORDS = "page int, seq long, x0 double, y0 double, x1 double, y1 double, text string"


def plain_lines(words):
    lines = []
    for w in sorted(words, key=lambda w: ((w[3] + w[5]) / 2, w[2], w[1])):
        yc = (w[3] + w[5]) / 2
        if lines and abs(yc - lines[-1]["mean"]) <= 3.0:
            lines[-1]["words"].append(w)
            lines[-1]["mean"] += (yc - lines[-1]["mean"]) / len(lines[-1]["words"])
        else:
            lines.append({"mean": yc, "words": [w]})
    for line in lines:
        line["words"].sort(key=lambda w: (w[2], (w[3] + w[5]) / 2, w[1]))
        line["y0"], line["y1"] = min(w[3] for w in line["words"]), max(w[5] for w in line["words"])
    return lines


def plain_headers(lines):
    found = []
    for line in lines:
        runs = []
        for w in line["words"]:
            if runs and w[2] - runs[-1][-1][4] <= 30:
                runs[-1].append(w)
            else:
                runs.append([w])
        for run in runs:
            text = " ".join(w[6] for w in run)
            category = next((c for c, p in S.HEADERS.items() if re.search(p, text.upper())), "unknown" if re.search(r"\bSCHEDULE\b", text.upper()) else None)
            if category:
                found.append({"category": category, "text": text, "box": (min(w[2] for w in run), min(w[3] for w in run), max(w[4] for w in run), max(w[5] for w in run))})
    return sorted(found, key=lambda h: h["box"][1])


def plain_band(lines, header):
    hx0, _, hx1, hy1 = header["box"]
    pattern = MARK_PATTERNS.get(header["category"])
    band, data = [], None
    for line in lines:
        if line["y0"] <= hy1:
            continue
        far = line["y0"] - hy1 > 60
        if far and not band:
            break
        near = [w for w in line["words"] if hx0 - 320 <= (w[2] + w[4]) / 2 <= hx1 + 320]
        if not near:
            continue
        if pattern and any(re.match(pattern, w[6].strip().upper()) for w in near):
            data = line["y0"]
            break
        band += near
        if far:
            break
    if data is not None:
        band = [w for w in band if w[5] <= data]
    return band if any(re.match(S.SUBHEADER, w[6].upper().rstrip(".")) for w in band) else []


def plain_columns(band):
    groups = []
    for w in sorted(band, key=lambda w: (w[2], (w[3] + w[5]) / 2, w[1])):
        if groups and w[2] <= max(v[4] for v in groups[-1]) + 14:
            groups[-1].append(w)
        else:
            groups.append([w])
    cols = [[" ".join(w[6] for w in sorted(g, key=lambda w: (round(w[3]), w[2], (w[3] + w[5]) / 2, w[1]))), min(w[2] for w in g), max(w[4] for w in g)] for g in groups]
    for a, b in zip(cols, cols[1:], strict=False):
        a[2] = b[1] = (a[2] + b[1]) / 2
    if cols:
        cols[0][1] -= 10
        cols[-1][2] += 10
    return cols


def plain_rows(lines, cols, bottom, category, stop):
    body, gaps, before = [], [], None
    for line in lines:
        if line["y0"] <= bottom:
            continue
        if stop is not None and line["y0"] >= stop:
            break
        inside = [w for w in line["words"] if cols[0][1] <= (w[2] + w[4]) / 2 <= cols[-1][2]]
        if not inside:
            continue
        if re.match(r"^NOTES?\b", inside[0][6].upper()):
            break
        if before is not None and gaps and line["y0"] - before > 2.5 * max(sorted(gaps)[len(gaps) // 2], 16.0):
            break
        if before is not None:
            gaps.append(line["y0"] - before)
        before = line["y1"]
        cells = [[] for _ in cols]
        for w in inside:
            at = next((i for i, c in enumerate(cols) if c[1] <= (w[2] + w[4]) / 2 <= c[2]), None)
            if at is not None:
                cells[at].append(w[6])
        body.append((line, inside, [" ".join(c) or None for c in cells]))
    pattern = MARK_PATTERNS.get(category)
    at = next((i for p in S.MARK_TITLES for i, c in enumerate(cols) if re.search(p, c[0].upper())), None)
    if at is None:
        hits = [sum(1 for _, _, c in body if c[i] and re.match(pattern, c[i].strip())) if pattern else 0 for i in range(len(cols))]
        at = hits.index(max(hits)) if hits and max(hits) > 0 else 0
    rows = []
    for line, inside, cells in body:
        text, mark = " ".join(w[6] for w in inside), None
        own = (cells[at] or "").strip()
        if pattern:
            window = (inside[:2] if len(inside) >= 4 else []) if category == "wall_type" else inside[:8]
            mark = next((w[6].strip().upper() for w in window if re.match(pattern, w[6].strip().upper())), None)
            if mark is None and category != "wall_type" and re.match(S.GENERIC_MARK, own.upper()):
                mark = own.upper()
        else:
            mark = own or None
        if mark or not rows:
            rows.append([mark, text, line["y0"], line["y1"]])
        else:
            rows[-1][1] += " " + text
            rows[-1][3] = line["y1"]
    return rows


def plain_schedules(words):
    rows, tables = set(), set()
    for page in {w[0] for w in words}:
        lines = plain_lines([w for w in words if w[0] == page])
        headers = plain_headers(lines)
        for t, h in enumerate(headers):
            band = plain_band(lines, h)
            cols = plain_columns(band)
            tables.add((page, t, h["category"], h["text"], len(cols)))
            if cols:
                stop = next((o["box"][1] for o in headers[t + 1 :] if o["box"][1] > h["box"][3]), None)
                for k, (mark, text, y0, y1) in enumerate(plain_rows(lines, cols, max(w[5] for w in band), h["category"], stop), 1):
                    rows.add((page, t, h["category"], k, mark, text, y0, y1))
    return rows, tables


def random_page(rng, page):
    """Schedules of any kind with drifting lines, wraps, notes and stray words."""
    words, y, seq = [], 10.0, iter(range(10_000))
    put = lambda x, y, text, wide=30.0: words.append((page, next(seq), float(x), float(y), float(x) + wide, float(y) + 8.0, text))
    for _ in range(rng.randint(1, 3)):
        title = rng.choice(["HOLDOWN SCHEDULE", "SHEAR WALL SCHEDULE", "POST SCHEDULE", "COLUMN SCHEDULE", "WALL SPEC", "DOOR SCHEDULE", "just words"])
        x = rng.choice([50, 60, 400])
        for k, part in enumerate(title.split()):
            put(x + 40 * k, y + rng.choice([0, 0.5]), part)
        y += rng.choice([12, 18, 30, 75])
        for k, name in enumerate(rng.sample(["MARK", "S.NO.", "TYPE", "SIZE", "NOTES.", "ID", "#"], rng.randint(1, 4))):
            put(x + rng.choice([0, 5]) + 70 * k, y + rng.choice([0, 0, 6, 7]), name)
        y += rng.choice([16, 24])
        for i in range(rng.randint(0, 6)):
            mark = rng.choice(["H1", "hd2", "SW-3", "P1", "C-4", "7", "12", "XX9Z", "600S162-43MIL", "50"])
            for k in range(rng.randint(1, 5)):
                put(x + 70 * k, y + rng.choice([0, 0, 1, 2, 2.5]), mark if k == 0 else rng.choice(["HDU5", "x", "tall", "H7", "8"]))
            if rng.random() < 0.2:
                put(x + 70, y + 8, "more")
            y += rng.choice([14, 20, 22, 26, 90])
        if rng.random() < 0.4:
            put(x, y, "NOTES")
        y += rng.choice([5, 40])
    for _ in range(rng.randint(0, 12)):
        put(rng.randint(0, 700), rng.uniform(0, y), rng.choice(["plan", "H1", "MARK", "SW-2"]), rng.choice([5.0, 30.0]))
    return words


def test_schedules_equal_a_walk_down_the_page(spark):
    rng = random.Random(4)
    words = [w for page in range(60) for w in random_page(rng, page)]
    got = S.read_schedules(spark.createDataFrame(words, WORDS).repartition(3))
    rows, tables = plain_schedules(words)
    assert {(r["page"], r["table_no"], r["category"], r["header_text"], r["n_columns"]) for r in got["tables"].collect()} == tables
    found = {(r["page"], r["table_no"], r["category"], r["row_no"], r["mark"], r["row_text"], r["y0"], r["y1"]) for r in got["rows"].collect()}
    assert found == rows and len(rows) > 60


def test_schedules_of_odd_words(spark):
    empty = spark.createDataFrame([], WORDS)
    assert all(t.count() == 0 for t in S.read_schedules(empty).values())
    odd = [(1, 1, None, 1.0, 2.0, 3.0, "HOLDOWN SCHEDULE"), (1, 2, 1.0, 1.0, 90.0, 9.0, None), (None, 3, 1.0, 1.0, 90.0, 9.0, "POST SCHEDULE"), (2, 4, 1.0, 1.0, 90.0, 9.0, "POST SCHEDULE")]
    got = S.read_schedules(spark.createDataFrame(odd, WORDS))
    assert [(r["page"], r["category"]) for r in got["tables"].where("page IS NOT NULL").collect()] == [(2, "post")]
    assert got["rows"].count() == 0
