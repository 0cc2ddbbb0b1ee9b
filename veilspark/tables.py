"""Word lists and formats that results depend on, in natural order."""

#: Kinds of finding, by priority: the first wins an overlap.
CATEGORIES = ("private_key", "jwt", "credential", "secret", "card", "email", "uuid", "ip", "host", "id", "pii", "client", "user", "custom")
PRIORITY = {name: k for k, name in enumerate(CATEGORIES)}

SENSITIVE_HEADERS = """
api-key apikey authorization cookie csrf-token ocp-apim-subscription-key private-token proxy-authorization
set-cookie token x-access-token x-amz-security-token x-api-key x-auth-token x-client-secret x-csrf-token
x-csrftoken x-goog-api-key x-hub-signature x-hub-signature-256 x-id-token x-refresh-token x-session-id
x-session-token x-signature x-token x-vault-token x-xsrf-token
""".split()

ALLOWED_DOMAINS = """
cloudflare.com example.com example.net example.org github.com google.com googleapis.com gstatic.com
jsdelivr.net mozilla.org schema.org unpkg.com w3.org
""".split()

SECRET_KEYS = "auth cookie cvc cvv otp pass pin pwd session sid sig signature ssn".split()
SECRET_KEY_PARTS = "apikey credential passwd password privatekey secret sessionid token".split()
METADATA_SUFFIXES = "expires expiresin length ttl type uri url".split()
SECRET_PARAMS = ["code"]
PII_KEYS = """
accountholder accountname address apellido birthdate cardholder cardholdername cedula cellphone celular
contactname correo customername direccion displayname dni dob document documentnumber email familyname
firstname fullname givenname holdername lastname login mail mobile name nationalid nickname nombre ownername
passport phone phonenumber street surname telefono username usuario
""".split()

PUBLIC_AUTH_PARAMS = "algorithm nc qop realm signedheaders uri".split()

DESCRIPTIVE_CLAIMS = """
acr alg amr authtime cty enc exp grant granttype groups gty iat locale nbf permissions role roles scope scp
tokenuse typ ver version zoneinfo
""".split()
ID_CLAIMS = "appid athash azp chash clientid jti kid nonce oid sid sub tid uid userid".split()
PII_CLAIMS = "aud email familyname givenname iss name nickname preferredusername uniquename upn username".split()

TLDS = """
agency ai app ar au bank be biz bo br ca ch cl cloud cn co com company corp cr cu de dev digital dk ec edu es
eu example fi finance fr global gov group gt health hk hn home ie il in info int internal intranet invalid io
it jp kr lan lat live local localdomain mil mx net network ni nl no nz online org pa pe pr pro pt ru se
security services sg shop site solutions store sv systems tech test tv tw uk us uy ve xyz za
""".split()
SECOND_LEVEL = """
ac.uk co.in co.jp co.kr co.nz co.uk co.za com.ar com.au com.bo com.br com.cn com.co com.ec com.es com.mx
com.pe com.sg com.uy com.ve edu.co gob.ar gob.cl gob.mx gob.pe gov.co gov.uk net.co org.co org.uk
""".split()

#: Accented letters and what they fold to, one to one.
ACCENTED, PLAIN = "áàäâãåéèëêíìïîóòöôõúùüûñçýÿ", "aaaaaaeeeeiiiiooooouuuuncyy"

STATIC_EXTENSIONS = "avif bmp css eot gif ico jpeg jpg js map mjs mp4 otf png svg ttf webm webp woff woff2".split()
STATIC_MIME_TYPES = "css font gif image jpeg png script svg".split()

#: Formats of what is looked for. Written for Python; ``\b \d \s`` are Unicode.
PRIVATE_KEY = r"-----BEGIN ([A-Z0-9 ]*)PRIVATE KEY-----[\s\S]*?-----END [A-Z0-9 ]*PRIVATE KEY-----"
JWT = r"\beyJ[A-Za-z0-9_-]{5,}\.eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]*"
VENDOR_TOKENS = (
    r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    r"\bgh[pousr]_[A-Za-z0-9]{36,}\b",
    r"\bgithub_pat_[A-Za-z0-9_]{22,}\b",
    r"\bglpat-[A-Za-z0-9_-]{20,}\b",
    r"\b[sr]k_(?:live|test)_[A-Za-z0-9]{16,}",
    r"\bsk-[A-Za-z0-9_-]{20,}",
    r"\bxox[abpors]-[A-Za-z0-9-]{10,}",
    r"\bAIza[0-9A-Za-z_-]{35}\b",
    r"\bya29\.[0-9A-Za-z_-]{20,}",
)
EMAIL = r"\b[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}\b"
CARD = r"\b\d(?:[ -]?\d){12,18}\b"
UUID = r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b"
IPV6 = r"[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}"
DOMAIN = r"\b(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+([A-Za-z]{2,24})\b"
PATH_ID = r"/(\d{2,})\b"
URL_CREDENTIALS = r"(?i)\b[a-z][a-z0-9+.-]*://([^\s:/@'\x22]+):([^\s@/'\x22]+)@"
HEADER = r"""(['"]?)([A-Za-z][A-Za-z0-9-]*)[ \t]*:[ \t]*"""
_QUOTED = r"""[ \t]+(?:'([^']*)'|"([^"]*)"|([^\s'"]+))"""
CURL_USER = rf"(?:^|\s)(?:-u|--user){_QUOTED}"
CURL_COOKIE = rf"(?:^|\s)(?:-b|--cookie){_QUOTED}"
AUTH_PARAM = r"""([A-Za-z0-9_-]+)=(?:"([^"]*)"|([^,\s]*))"""
JSON_STRING_PAIR = r"""\\?"([A-Za-z0-9_.$@-]{1,64})\\?"[ \t]*:[ \t]*(\\?")"""
JSON_NUMBER_PAIR = r"""\\?"([A-Za-z0-9_.$@-]{1,64})\\?"[ \t]*:[ \t]*(\d{2,})\b"""
NAME_VALUE = r"""\\?"(?:name|key)\\?"\s*:\s*\\?"([^"\\\r\n]{1,128})\\?"\s*,\s*\\?"value\\?"\s*:\s*(\\?")"""
VALUE_FOLLOWS = r"""\\?"\s*,\s*\\?"value\\?"\s*:"""
VERSION_FOLLOWS = r"""\\?"\s*,\s*\\?"version\\?"\s*:"""
COOKIES_ARRAY = r"""\\?"cookies\\?"\s*:\s*\["""
PARAM = r"""(?m)(?:^|[?&;\s])([A-Za-z0-9_.\[\]-]{1,64})=([^&\s"'#;<>\\]*)"""
BURP_BASE64 = r'base64="true"><!\[CDATA\[([A-Za-z0-9+/=\s]*)\]\]>'
WORD = r"\w+(?:[-_]\w+)*|\S"
