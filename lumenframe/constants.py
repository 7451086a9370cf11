"""Fixed values of the spectral operators: windows, anchors, thresholds and grids (wavenumbers in 1/cm)."""

CROP = (1000.0, 1800.0)
D1 = ((1300.0, 1400.0), ((1200.0, 1270.0), (1420.0, 1460.0), (1700.0, 1740.0)))
GD2 = ((1540.0, 1660.0), ((1420.0, 1480.0), (1700.0, 1760.0)))
CONTROL = ((1710.0, 1770.0), ((1680.0, 1705.0), (1775.0, 1798.0)))
CONTRAST_BAND, CONTRAST_FREE = (1540.0, 1660.0), (1700.0, 1790.0)
D_PEAK, G_PEAK = (1330.0, 1370.0), (1560.0, 1610.0)
MAXBAND = (1550.0, 1620.0)
DESPIKE = 12.0
SG_WINDOW, SG_ORDER = 7, 3
SIMILARITY_FLOOR, DISORDER_DELTA, ENDMEMBER_MATCH, NEIGHBOURS = 0.65, 0.06, 0.9, 5
FIT_COLUMNS = ("G_I", "G_W", "G_A", "D3_I", "D3_W", "D3_A", "R_I", "R_W", "R_A")
FIT_BOUNDS = {"G_W": (10.0, 35.0), "D3_W": (40.0, 200.0)}
AXIS_MIN_POINTS, AXIS_MIN_SPAN, AXIS_MIN_STEP, AXIS_MAX_STEP = 16, 100.0, 0.05, 60.0
SHIFT_ENVELOPE = (-300.0, 4500.0)
