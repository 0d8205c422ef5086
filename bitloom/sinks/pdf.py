"""Reports as PDF, without a PDF library.

Text is set in STSong-Light, a font that PDF viewers bring along for Chinese; it has Latin letters too, so
no font file is needed. Code points beyond the BMP, which its encoding lacks, become U+FFFD.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

#: A4 in points.
WIDTH, HEIGHT, MARGIN = 595, 842, 40
SIZE, LEADING, PAD = 9, 12, 3


def _advance(c: str) -> float:
    """Of a character in ems: the font sets ASCII half wide, in the encoding chosen below."""
    return 0.5 if " " <= c <= "~" else 1.0


def wrapped(text: str, width: float, size: float = SIZE) -> list[str]:
    """Lines no wider than width points; a line breaks after its last space if it has one."""
    lines = []
    for line in text.splitlines() or [""]:
        now, used, space = "", 0.0, -1
        for c in line:
            w = _advance(c) * size
            if now and used + w > width:
                cut = space + 1 if space > 0 else len(now)
                lines.append(now[:cut].rstrip(" "))
                now = now[cut:]
                used, space = sum(map(_advance, now)) * size, now.rfind(" ")
            if c == " ":
                space = len(now)
            now, used = now + c, used + w
        lines.append(now)
    return lines


def _shown(text: str, x: float, y: float, size: float) -> str:
    plain = "".join("�" if ord(c) > 0xFFFF or 0xD800 <= ord(c) < 0xE000 or ord(c) < 32 else c for c in text)
    return f"BT /F {size} Tf {x:.1f} {y:.1f} Td <{plain.encode('utf-16-be').hex()}> Tj ET"


def _pages(title: str, lines: list[str], columns: list[str], rows: list[tuple]) -> Iterator[list[str]]:
    page: list[str] = []
    y, wide = HEIGHT - MARGIN, WIDTH - 2 * MARGIN
    for text, size in [(title, 16), *(("• " + x, SIZE) for x in lines)]:
        for line in wrapped(text, wide, size):
            if y - size < MARGIN:
                yield page
                page, y = [], HEIGHT - MARGIN
            y -= size * LEADING / SIZE
            page.append(_shown(line, MARGIN, y, size))
    y -= LEADING
    each = wide / max(len(columns), 1)
    for row in [columns, *rows] if rows else []:
        cells = [wrapped("" if v is None else str(v), each - 2 * PAD) for v in row]
        while any(cells):  # a row that is taller than what is left goes on over the next page
            fits = int((y - MARGIN - 2 * PAD) // LEADING)
            if fits < 1 or max(map(len, cells)) > fits and y < HEIGHT - MARGIN and max(map(len, cells)) * LEADING < HEIGHT - 2 * MARGIN - 2 * PAD:
                yield page
                page, y = [], HEIGHT - MARGIN
                continue
            tall = min(fits, max(map(len, cells)))
            low = y - tall * LEADING - 2 * PAD
            for i, cell in enumerate(cells):
                page.append(f"{MARGIN + i * each:.1f} {low:.1f} {each:.1f} {y - low:.1f} re S")
                page += [_shown(t, MARGIN + i * each + PAD, y - PAD - (k + 1) * LEADING + 3, SIZE) for k, t in enumerate(cell[:tall])]
            cells, y = [cell[tall:] for cell in cells], low
    yield page


def put(title: str, lines: list[str], columns: list[str], rows: list[tuple], path: str) -> None:
    """Writes the title, a list of lines and a table, and moves the file into place when it is whole."""
    streams = ["\n".join(["0.5 w 0.5 G", *p]).encode() for p in _pages(title, lines, columns, rows)]
    kids = [5 + 2 * i for i in range(len(streams))]
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        f"<< /Type /Pages /Count {len(kids)} /Kids [{' '.join(f'{k} 0 R' for k in kids)}] >>".encode(),
        b"<< /Type /Font /Subtype /Type0 /BaseFont /STSong-Light /Encoding /UniGB-UCS2-H /DescendantFonts [4 0 R] >>",
        b"<< /Type /Font /Subtype /CIDFontType0 /BaseFont /STSong-Light /CIDSystemInfo << /Registry (Adobe) /Ordering (GB1) /Supplement 4 >> /DW 1000 /W [1 95 500]"
        b" /FontDescriptor << /Type /FontDescriptor /FontName /STSong-Light /Flags 6 /FontBBox [-25 -254 1000 880] /ItalicAngle 0 /Ascent 880 /Descent -120 /CapHeight 880 /StemV 93 >> >>",
    ]
    for k, s in zip(kids, streams):
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {WIDTH} {HEIGHT}] /Resources << /Font << /F 3 0 R >> >> /Contents {k + 1} 0 R >>".encode())
        objects.append(f"<< /Length {len(s)} >>\nstream\n".encode() + s + b"\nendstream")
    out, starts = bytearray(b"%PDF-1.4\n"), []
    for i, body in enumerate(objects, 1):
        starts.append(len(out))
        out += f"{i} 0 obj\n".encode() + body + b"\nendobj\n"
    at = len(out)
    out += f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{s:010d} 00000 n \n".encode() for s in starts)
    out += f"trailer\n<< /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{at}\n%%EOF\n".encode()
    with open(f"{path}.part", "wb") as f:
        f.write(out)
    os.replace(f"{path}.part", path)
