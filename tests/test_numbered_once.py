"""Anchor frames: static segments and events share one numbering and one table of levels."""

from keepsake.operators import series as R
from keepsake.plans import REGISTRY, Tables


def test_numbered_once(spark, monkeypatch):
    made = []
    for name in ("ranged", "series_stats"):
        plain = getattr(R, name)
        monkeypatch.setattr(R, name, lambda *a, _f=plain, _n=name, **k: made.append(_n) or _f(*a, **k))
    out = REGISTRY["visual_event_frames"].build(Tables(spark, "/root/testdata/sf0.001"))
    assert made == ["ranged", "series_stats"] and out.columns == ["series_id", "t"]
