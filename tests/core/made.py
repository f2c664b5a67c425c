"""Documents built by hand, for several tests."""

import zlib

from quire.plans.extract import Documents


def build(objects: dict[int, bytes], root: int = 1, extra: bytes = b"") -> bytes:
    out, places = b"%PDF-1.7\n", {}
    for n, body in objects.items():
        places[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    at = len(out)
    out += b"xref\n0 1\n0000000000 65535 f \n" + b"".join(b"%d 1\n%010d 00000 n \n" % (n, p) for n, p in places.items())
    return out + b"trailer\n<< /Size %d /Root %d 0 R %s >>\nstartxref\n%d\n%%%%EOF\n" % (max(objects) + 1, root, extra, at)


def stream(data: bytes, entries: bytes = b"") -> bytes:
    return b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(data), entries, data)


BASE = {
    1: b"<< /Type /Catalog /Pages 2 0 R >>",
    2: b"<< /Type /Pages /Kids [3 0 R 6 0 R] /Count 3 /MediaBox [0 0 300 400] /Rotate 90 >>",
    3: b"<< /Type /Page /Parent 2 0 R /Contents [4 0 R 5 0 R] >>",
    4: stream(zlib.compress(b"BT /F1 10 Tf 50 60 Td (Hello\\051) Tj"), b"/Filter /FlateDecode"),
    5: stream(b"0 -12 Td [(Wor) -200 <6C64>] TJ ET q 2 0 0 2 5 5 cm 10 20 30 40 re f Q"),
    6: b"<< /Type /Pages /Parent 2 0 R /Kids [7 0 R 2 0 R 8 0 R] >>",
    7: b"<< /Type /Page /Parent 6 0 R /MediaBox [200 100 0 0] /Rotate 180 >>",
    8: b"<< /Type /Page /Parent 6 0 R /CropBox [10 10 20 30] >>",
}


def documents(spark, *contents):
    return Documents(spark.createDataFrame([(k, bytearray(c) if c is not None else None) for k, c in enumerate(contents)], "doc_id long, content binary"))
