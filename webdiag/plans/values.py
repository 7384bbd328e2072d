"""Fixed values of the oracle SQL, written out here so that
a wrong constant of the engine does not pass its own check."""

# --- fixed values (must equal the reference's for equal results) ---------
# console
SEVERITY_RANK = {'error': 3, 'warning': 2, 'warn': 2, 'info': 1, 'log': 1, 'verbose': 0, 'debug': 0}
UNKNOWN_RANK = 1
FINGERPRINT_CHARS = 200
# styles
TIER1 = (
    'display', 'visibility', 'opacity', 'position', 'z-index', 'width', 'height', 'min-width', 'max-width',
    'min-height', 'max-height', 'overflow', 'overflow-x', 'overflow-y', 'top', 'right', 'bottom', 'left',
    'flex', 'flex-direction', 'flex-wrap', 'flex-grow', 'flex-shrink', 'flex-basis', 'align-items',
    'align-self', 'justify-content', 'justify-self', 'grid-template-columns', 'grid-template-rows',
    'grid-column', 'grid-row', 'transform', 'clip-path', 'clip', 'margin', 'margin-top', 'margin-right',
    'margin-bottom', 'margin-left', 'padding', 'padding-top', 'padding-right', 'padding-bottom',
    'padding-left', 'border', 'border-width', 'border-style', 'border-color', 'box-sizing', 'pointer-events',
)
TIER2 = (
    'color', 'background-color', 'background', 'font-size', 'font-weight', 'line-height', 'text-align',
    'cursor', 'box-shadow', 'outline',
)
DULL_VALUES = (
    'rgba(0, 0, 0, 0)', 'transparent', 'none', 'normal', 'auto', 'rgb(0, 0, 0)', '0px', 'inherit', 'initial',
)
BOX_MODEL = (
    'margin', 'margin-top', 'margin-right', 'margin-bottom', 'margin-left', 'padding', 'padding-top',
    'padding-right', 'padding-bottom', 'padding-left', 'border', 'border-width',
)
PARSE_FLOAT_RE = r'^\s*([+-]?(?:Infinity|\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?))'
# rules
NOTE_FLEX_OVERFLOW = 'overflow:hidden on a flex/grid container can clip children unexpectedly'
NOTE_UNANCHORED = 'position:{} with no top/right/bottom/left (element position depends on default flow)'
NOTE_Z_INDEX = 'z-index has no effect on position:static elements'
# frames
TRIM_RE = r'^\s+|\s+\z'
FRAME_RE = r'at\s+(?:(.+?)\s+\()?([^()\s]+?):(\d+):(\d+)\)?\z'
INTERNAL_RE = 'node_modules|webpack-internal'
KEEP_FRAMES = 3
MINIFIED_URL_RE = r'\.(min|bundle|chunk)\.js(\?|\z)|/dist/|/build/|/_next/static/chunks/'
MINIFIED_MIN_COLUMN = 200
# urls
SOURCE_URL_RE = r'^((?:[\w+\-.]+:)?//(?:\w+:\w+@)?[\w.\-]*(?::\d+)?)(.*)\z'
# selectors
ID_TOKEN_RE = r'#([\w-]+)'
CLASS_TOKEN_RE = r'\.([\w-]+)'
# maps
MAP_REFERENCE_RE = r'//[#@]\s*sourceMappingURL=(\S+)'
DATA_BASE64_RE = r';base64,(.*)\z'
# payloads
FENCE_RE = r'```(?:json)?\s*([\s\S]*?)\s*```'
NO_MESSAGES_RE = '(?i)no console messages'
MARKDOWN_HEADING_RE = r'(?m)^##\s'
NOISE_PATTERNS = (
    '^Warning: Each child in a list should have a unique "key" prop',
    r'^Warning: React does not recognize the `\w+` prop on a DOM element',
    r'^\[HMR\]',
    r'^\[vite\]',
    '^Download the React DevTools',
    '^Warning: ReactDOM.render is no longer supported',
    '(?i:is deprecated and will be removed)',
    r'^\[webpack\]',
)
# ------------------------------------------------------------------------
