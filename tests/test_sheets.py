import io
import tracemalloc

from sparkloom.sources import sheets


def test_long_sheets_are_read_row_by_row():
    made = io.BytesIO()
    sheets.write(made, ["id", "text"], ([i, f"<{i}>"] for i in range(40_000)))
    made.seek(0)
    tracemalloc.start()
    count = sum(r == {"text": f"<{i}>", "id": str(i)} for i, r in enumerate(sheets.read(made, ["text", "id"])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count == 40_000 and most < 8 << 20
