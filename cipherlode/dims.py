"""What is known of algorithms and packages, as small tables.

Fixed values: names of algorithms, packages, members and groups are those that
their specifications and packages use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cipherlode import catalogue

CLASSES = ["public-key", "post-quantum", "symmetric", "hash", "kdf", "random", "unknown"]

#: class and kind -> families. Fixed values.
FAMILIES = {
    ("public-key", "key-agreement"): ["ECDH", "X25519", "X448", "DH", "DH/ECDH"],
    ("public-key", "signature"): ["ECDSA", "Ed25519", "Ed448", "EdDSA", "Schnorr", "BLS", "DSA", "RSA-PSS", "RSASSA-PKCS1-v1_5", "RSA raw signature", "Signature", "OpenPGP signature"],
    ("public-key", "public-key-encryption"): ["RSA-OAEP", "RSAES-PKCS1-v1_5", "ECIES", "X25519-XSalsa20-Poly1305", "X25519 sealed box", "HPKE DHKEM", "OpenPGP"],
    ("public-key", "public-key"): ["RSA", "EC"],
    ("post-quantum", "kem"): ["ML-KEM", "Kyber", "Hybrid KEM"],
    ("post-quantum", "pq-signature"): ["ML-DSA", "SLH-DSA"],
    ("symmetric", "cipher"): ["AES", "ChaCha20-Poly1305", "XChaCha20-Poly1305", "XSalsa20-Poly1305", "ChaCha20", "Salsa20", "3DES", "DES", "RC4", "RC2", "Blowfish", "Rabbit"],
    ("symmetric", "mac"): ["HMAC", "KMAC"],
    ("hash", "hash"): ["Hash"],
    ("kdf", "kdf"): ["HKDF", "PBKDF2"],
    ("kdf", "password-hash"): ["scrypt", "Argon2", "Argon2id", "Argon2i", "Argon2d", "bcrypt"],
    ("random", "random"): ["CSPRNG"],
    ("unknown", "unknown"): ["Unknown"],
}

#: Names of hybrid key exchanges, matched in any case. Fixed values.
HYBRIDS = ["X25519MLKEM768", "SecP256r1MLKEM768", "SecP384r1MLKEM1024", "MLKEM768-X25519", "X-Wing", "X25519Kyber768Draft00", "X25519Kyber768", "x25519_kyber768", "p256_kyber768", "curveSM2MLKEM768"]

#: Bits of the MODP groups. Fixed values.
MODP = {"modp1": 768, "modp2": 1024, "modp5": 1536, "modp14": 2048, "modp15": 3072, "modp16": 4096, "modp17": 6144, "modp18": 8192}

#: Curves by their spellings without blanks, hyphens and underscores. Fixed values.
CURVES = {
    "P-256": ["p256", "prime256v1", "secp256r1", "nistp256"], "P-384": ["p384", "secp384r1", "nistp384"], "P-521": ["p521", "secp521r1", "nistp521"],
    "P-224": ["p224", "secp224r1"], "P-192": ["p192", "prime192v1", "secp192r1"], "secp256k1": ["secp256k1", "k256"],
    "X25519": ["x25519", "curve25519"], "X448": ["x448", "curve448"], "Ed25519": ["ed25519"], "Ed448": ["ed448"],
}

#: What a note's code means, in our words.
NOTES = {
    "aes-128": "A 128-bit AES key: prefer 256 bits where data must stay secret for decades.",
    "weak-hash": "Collisions for this hash are practical now; replace it wherever one would do harm.",
    "replace-now": "This cipher is broken or too weak already, without any quantum computer.",
    "ecb": "ECB lets patterns of the data through; use another mode.",
    "pbkdf2-iterations": "Fewer than 100,000 PBKDF2 iterations is too few today.",
    "unsigned": "A token with alg none carries no signature.",
    "pre-standard": "Kyber from before the standard; move to ML-KEM.",
    "not-catalogued": "The name is not known here; look at it by hand.",
    "key-decides": "The key given at run time sets the algorithm.",
    "declared-here": "Only the declaration is here; see whether the call gets this value.",
    "library-default": "Not written at the call; the library's documented default.",
    "parameter-not-literal": "A parameter is not written here; look at it by hand.",
    "groups-unstated": "No key-exchange group is written, so the library's default decides.",
    "hybrid-needs-tls13": "A hybrid group is listed while TLS 1.3 is off; it will never be used.",
    "old-protocol": "SSL, TLS 1.0 or TLS 1.1 is on.",
    "weak-ciphers": "The cipher list lets RC4, DES, MD5, NULL or export ciphers in.",
    "options-not-literal": "The options are not written here; look at them by hand.",
}

#: SubtleCrypto methods and the places of their algorithm arguments. Fixed values.
SUBTLE = {
    "encrypt": [0], "decrypt": [0], "sign": [0], "verify": [0], "digest": [0], "deriveBits": [0], "generateKey": [0], "deriveKey": [0, 2], "importKey": [2],
    "wrapKey": [3], "unwrapKey": [3, 4], "encapsulateBits": [0], "encapsulateKey": [0, 2], "decapsulateBits": [0], "decapsulateKey": [0, 3],
}

RANDOM_METHODS = ["randomBytes", "randomUUID", "randomInt", "randomFill", "randomFillSync", "getRandomValues", "pseudoRandomBytes"]

#: Word patterns that decide a priority. Fixed values.
SEAL_WORDS = r"^(seal|unseal|encrypt|decrypt|(un)?wrap|stor(e|ed|es|age|ing)$|envelope|archiv|backup|persist)"
SESSION_WORDS = r"^(tls$|sessions?$|handshake|transport|sockets?$)"
SIGN_WORDS = r"^(sign(s|ed|ing|er|ature|atures)?$|verif|jwt$|auth|webauthn$|passkeys?$|assertions?$|cose$|certs?$|certificates?$|x509$)"

DECIDING = {"seal": SEAL_WORDS, "session": SESSION_WORDS, "sign": SIGN_WORDS}

#: Catalogued packages, and whether they do post-quantum cryptography.
PACKAGES = {p: pq for pq, names in catalogue.POST_QUANTUM.items() for p in names}

#: Node calls that configure TLS: servers always count, clients where they write a TLS field. Fixed values.
TLS_SERVERS = ["tls.createServer", "tls.createSecureContext", "https.createServer", "http2.createSecureServer"]
TLS_CLIENTS = ["tls.connect", "https.request", "https.get", "https.Agent", "http2.connect"]


def families(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f, c, k) for (c, k), names in FAMILIES.items() for f in names], "family string, class string, kind string")


def notes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(NOTES.items()), "code string, text string")


LIBRARY_CALL = "package string, member string, is_subpath boolean, family string, curve string, hash string, mode string, bits long, name string, note string, also string, size_at string, iterations_at string, cipher_at string, key_type_at string, curve_at string"


def library_calls(spark: SparkSession) -> DataFrame:
    """A row for each catalogued member; hash and curve members come from their names."""
    from cipherlode.functions.names import curve_name, hash_name_of

    rows = [{"package": p, "is_subpath": below, **c} for below, table in ((False, catalogue.CALLS), (True, catalogue.SUBPATHS)) for p, calls in table.items() for c in calls]
    rows += [{"package": p, "is_subpath": False, **catalogue.call(m, "Hash", hash=hash_name_of(m.rpartition(".")[2]))} for p, names in catalogue.HASH_MEMBERS.items() for m in names.split()]
    for p, names in catalogue.CURVE_MEMBERS.items():
        for m in names.split():
            uses = {"": "EC", ".sign": "ECDSA", ".verify": "ECDSA", ".getSharedSecret": "ECDH"}
            rows += [{"package": p, "is_subpath": False, **catalogue.call(m + end, family, curve=curve_name(m))} for end, family in uses.items()]
    return spark.createDataFrame([tuple(r.get(c.split()[0]) for c in LIBRARY_CALL.split(", ")) for r in rows], LIBRARY_CALL)


def libraries(spark: SparkSession) -> DataFrame:
    """(package, post_quantum, jose, has_calls, provides); provides lists the families of the calls."""
    rows = []
    for p, pq in PACKAGES.items():
        calls, more = catalogue.CALLS.get(p, []), {"Hash": catalogue.HASH_MEMBERS, "EC, ECDH, ECDSA": catalogue.CURVE_MEMBERS, "JSON Web Algorithms": catalogue.JOSE}
        families = {c["family"] for c in calls} | {f for names, held in more.items() if p in held for f in names.split(", ")}
        rows.append((p, pq, p in catalogue.JOSE, bool(calls) or p in catalogue.HASH_MEMBERS, ", ".join(sorted(families))))
    return spark.createDataFrame(rows, "package string, post_quantum string, jose boolean, has_calls boolean, provides string")


def plain_members(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, m) for p, names in catalogue.PLAIN.items() for m in names], "package string, member string")
