"""Small inputs of the library's own: an invented seed shop's console log and
the computed styles of an element faded out by its opacity."""

# Two kinds of repeated error, two single ones, three warnings and an info,
# between a line of each kind of noise.
STOCK_ERROR = "RangeError: shelf 7 holds no seed packet"
PRICE_ERROR = "Uncaught (in promise) Error: price list out of date"
PAINT_ERROR = "Canvas refused to paint the herb map"
SLOW_WARNING = "Watering schedule took too long to load"
OLD_WARNING = "moonCalendar() will go away in the next season"
NOISE = (
    'Warning: Each child in a list should have a unique "key" prop. See the seed table.',
    "Warning: React does not recognize the `leafColor` prop on a DOM element.",
    "[HMR] seed table swapped",
    "[vite] connected to the greenhouse",
    "Download the React DevTools for the greenhouse",
    "Warning: ReactDOM.render is no longer supported by the potting bench",
    "plantOut() Is Deprecated And Will Be Removed in spring",
    "[webpack] compost turned",
)
SHOP_LOG = (
    [("info", "Good morning from the seed shop", "hello.mjs", None)]
    + [("warning", NOISE[0], "table.mjs", None), ("error", STOCK_ERROR, "shelf.mjs", "https://seeds.example.org/shelf")]
    + [("log", NOISE[2], "dev", None), ("error", PRICE_ERROR, None, "https://seeds.example.org/prices")]
    + [("error", STOCK_ERROR, "shelf.mjs", "https://seeds.example.org/shelf")] * 4
    + [("warn", SLOW_WARNING, "water.mjs", None), ("error", NOISE[1], "table.mjs", None), ("log", NOISE[3], "dev", None)]
    + [("error", PRICE_ERROR, None, "https://seeds.example.org/prices"), ("error", PAINT_ERROR, "map.mjs", None)]
    + [("warning", OLD_WARNING, "moon.mjs", None), ("warn", SLOW_WARNING, "water.mjs", None)]
    + [("warning", NOISE[4], "dev", None), ("error", NOISE[5], "dev", None), ("warn", NOISE[6], "dev", None), ("log", NOISE[7], "dev", None)]
)
N_ENTRIES = len(SHOP_LOG)


def noisy_entries(spark, capture="page-1"):
    rows = [(capture, i, lvl, txt, src, url) for i, (lvl, txt, src, url) in enumerate(SHOP_LOG)]
    return spark.createDataFrame(
        rows, "capture_id string, seq bigint, level string, text string, source string, url string")


# 16 tier-1 properties (5 of them box model), 4 tier-2 ones (two with a dull
# value) and 3 others.
FADED_STYLES = {
    "opacity": "0", "display": "grid", "visibility": "visible", "position": "sticky", "top": "12px",
    "width": "340px", "height": "27px", "min-width": "60px", "overflow": "visible", "grid-row": "2",
    "transform": "rotate(3deg)", "margin-top": "4px", "margin-left": "9px", "padding": "3px",
    "padding-right": "6px", "border-width": "2px",
    "color": "rgb(14, 99, 51)", "text-align": "center", "box-shadow": "none", "background": "transparent",
    "-webkit-user-drag": "none", "transition-delay": "40ms", "hyphens": "manual",
}


def elements(spark, style_maps, capture="c1"):
    """DataFrame(capture_id, pos, selector, styles) from a list of dicts."""
    rows = [(capture, i, f"#el{i}", m) for i, m in enumerate(style_maps)]
    return spark.createDataFrame(rows, "capture_id string, pos int, selector string, styles map<string,string>")
