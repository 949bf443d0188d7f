"""The catalogued packages: which members of theirs use what, a row for each. Names are those of the packages."""

from __future__ import annotations


def call(member: str, family: str, **more: str | int) -> dict:
    """A member, "()" for the package itself, "*" for any other. more: what it fixes (curve, hash, mode, bits, name, note, also: a second family), and places of arguments that say it (..._at)."""
    return {"member": member, "family": family, **more}


_SODIUM = [
    call("crypto_box_seal", "X25519 sealed box"), call("crypto_box", "X25519-XSalsa20-Poly1305"), call("crypto_kx", "X25519"), call("crypto_scalarmult", "X25519"),
    call("crypto_sign", "Ed25519"), call("crypto_secretbox", "XSalsa20-Poly1305"), call("crypto_aead_xchacha20poly1305_ietf", "XChaCha20-Poly1305"),
    call("crypto_secretstream_xchacha20poly1305", "XChaCha20-Poly1305"), call("crypto_aead_chacha20poly1305", "ChaCha20-Poly1305"),
    call("crypto_aead_aes256gcm", "AES", bits=256, mode="GCM"), call("crypto_pwhash_scryptsalsa208sha256", "scrypt"), call("crypto_pwhash", "Argon2id"),
    call("crypto_generichash", "Hash", hash="BLAKE2b"), call("crypto_hash_sha256", "Hash", hash="SHA-256"), call("crypto_hash_sha512", "Hash", hash="SHA-512"),
    call("crypto_hash", "Hash", hash="SHA-512"), call("crypto_auth_hmacsha256", "HMAC", hash="SHA-256"), call("crypto_auth_hmacsha512", "HMAC", hash="SHA-512"),
    call("randombytes", "CSPRNG"),
]
_BCRYPT = [
    call("hash", "bcrypt"), call("hashSync", "bcrypt"), call("genSalt", "bcrypt"), call("genSaltSync", "bcrypt"), call("compare", "bcrypt"), call("compareSync", "bcrypt"),
]
_KEM = [
    call("MlKem512", "ML-KEM", name="ML-KEM-512"), call("MlKem768", "ML-KEM", name="ML-KEM-768"), call("MlKem1024", "ML-KEM", name="ML-KEM-1024"),
]
_SAML = [
    call("Strategy", "Signature", name="SAML signature", note="key-decides"),
]

#: Calls by package.
CALLS = {
    "tweetnacl": [
        call("box", "X25519-XSalsa20-Poly1305"), call("scalarMult", "X25519"), call("sign", "Ed25519"), call("secretbox", "XSalsa20-Poly1305"),
        call("hash", "Hash", hash="SHA-512"), call("randomBytes", "CSPRNG"),
    ],
    "libsodium-wrappers": _SODIUM,
    "libsodium-wrappers-sumo": _SODIUM,
    "sodium-native": _SODIUM,
    "@noble/curves": [
        call("ed25519", "Ed25519"), call("ed25519ph", "Ed25519"), call("ed25519ctx", "Ed25519"), call("ed448", "Ed448"), call("x25519", "X25519"), call("x448", "X448"),
        call("schnorr", "Schnorr", curve="secp256k1"), call("bls12_381", "BLS"),
    ],
    "@noble/ed25519": [call("*", "Ed25519")],
    "@noble/secp256k1": [
        call("*", "EC", curve="secp256k1"), call("sign", "ECDSA", curve="secp256k1"), call("signAsync", "ECDSA", curve="secp256k1"), call("verify", "ECDSA", curve="secp256k1"),
        call("getSharedSecret", "ECDH", curve="secp256k1"),
    ],
    "@noble/hashes": [
        call("hmac", "HMAC"), call("hkdf", "HKDF"), call("pbkdf2", "PBKDF2"), call("pbkdf2Async", "PBKDF2"), call("scrypt", "scrypt"), call("scryptAsync", "scrypt"),
        call("argon2id", "Argon2id"), call("argon2i", "Argon2i"), call("argon2d", "Argon2d"),
    ],
    "@noble/ciphers": [
        call("gcm", "AES", mode="GCM"), call("siv", "AES", mode="GCM-SIV"), call("gcmsiv", "AES", mode="GCM-SIV"), call("cbc", "AES", mode="CBC"), call("ctr", "AES", mode="CTR"),
        call("ecb", "AES", mode="ECB"), call("aeskw", "AES", mode="KW"), call("chacha20poly1305", "ChaCha20-Poly1305"), call("xchacha20poly1305", "XChaCha20-Poly1305"),
        call("xsalsa20poly1305", "XSalsa20-Poly1305"), call("chacha20", "ChaCha20"), call("salsa20", "Salsa20"),
    ],
    "@noble/post-quantum": [
        call("ml_kem512", "ML-KEM", name="ML-KEM-512"), call("ml_kem768", "ML-KEM", name="ML-KEM-768"), call("ml_kem1024", "ML-KEM", name="ML-KEM-1024"),
        call("ml_dsa44", "ML-DSA", name="ML-DSA-44"), call("ml_dsa65", "ML-DSA", name="ML-DSA-65"), call("ml_dsa87", "ML-DSA", name="ML-DSA-87"), call("slh_dsa", "SLH-DSA"),
        call("ml_kem768_x25519", "Hybrid KEM", name="MLKEM768-X25519"), call("xwing", "Hybrid KEM", name="X-Wing"), call("XWing", "Hybrid KEM", name="X-Wing"),
        call("ml_kem768_p256", "Hybrid KEM", name="SecP256r1MLKEM768"), call("ml_kem1024_p384", "Hybrid KEM", name="SecP384r1MLKEM1024"),
    ],
    "node-forge": [
        call("pki.rsa", "RSA", size_at="0.bits"), call("pki.ed25519", "Ed25519"), call("ed25519", "Ed25519"), call("cipher.createCipher", "AES", cipher_at="0"),
        call("cipher.createDecipher", "AES", cipher_at="0"), call("pkcs5.pbkdf2", "PBKDF2", iterations_at="2"), call("random", "CSPRNG"),
    ],
    "elliptic": [call("ec", "EC", curve_at="0"), call("eddsa", "Ed25519")],
    "jsrsasign": [call("KEYUTIL.generateKeypair", "RSA", key_type_at="0")],
    "bcrypt": _BCRYPT,
    "bcryptjs": _BCRYPT,
    "argon2": [call("hash", "Argon2"), call("verify", "Argon2")],
    "scrypt-js": [call("scrypt", "scrypt"), call("syncScrypt", "scrypt")],
    "hash-wasm": [call("argon2id", "Argon2id"), call("bcrypt", "bcrypt"), call("scrypt", "scrypt"), call("pbkdf2", "PBKDF2")],
    "crypto-js": [
        call("AES", "AES"), call("DES", "DES"), call("TripleDES", "3DES"), call("RC4", "RC4"), call("RC4Drop", "RC4"), call("Rabbit", "Rabbit"),
        call("SHA3", "Hash", hash="SHA-3"), call("HmacMD5", "HMAC", hash="MD5"), call("HmacSHA1", "HMAC", hash="SHA-1"), call("HmacSHA256", "HMAC", hash="SHA-256"),
        call("HmacSHA512", "HMAC", hash="SHA-512"), call("PBKDF2", "PBKDF2", iterations_at="2.iterations"),
    ],
    "openpgp": [
        call("encrypt", "OpenPGP", note="key-decides"), call("decrypt", "OpenPGP", note="key-decides"), call("sign", "OpenPGP signature", note="key-decides"),
        call("verify", "OpenPGP signature", note="key-decides"),
    ],
    "mlkem": _KEM,
    "@hpke/ml-kem": _KEM,
    "crystals-kyber-js": [call("Kyber512", "Kyber", name="Kyber512"), call("Kyber768", "Kyber", name="Kyber768"), call("Kyber1024", "Kyber", name="Kyber1024")],
    "pqc-kyber": [call("*", "Kyber")],
    "eth-crypto": [
        call("encryptWithPublicKey", "ECIES", curve="secp256k1"), call("decryptWithPrivateKey", "ECIES", curve="secp256k1"), call("sign", "ECDSA", curve="secp256k1"),
        call("recover", "ECDSA", curve="secp256k1"), call("recoverPublicKey", "ECDSA", curve="secp256k1"), call("createIdentity", "EC", curve="secp256k1"),
    ],
    "secp256k1": [
        call("ecdsaSign", "ECDSA", curve="secp256k1"), call("ecdsaVerify", "ECDSA", curve="secp256k1"), call("ecdh", "ECDH", curve="secp256k1"),
        call("*", "EC", curve="secp256k1"),
    ],
    "web-push": [
        call("sendNotification", "ECDH", curve="P-256", also="ECDSA"), call("generateRequestDetails", "ECDH", curve="P-256", also="ECDSA"), call("encrypt", "ECDH", curve="P-256"),
        call("generateVAPIDKeys", "ECDSA", curve="P-256"), call("setVapidDetails", "ECDSA", curve="P-256"), call("getVapidHeaders", "ECDSA", curve="P-256"),
    ],
    "http_ece": [call("encrypt", "AES", bits=128, mode="GCM"), call("decrypt", "AES", bits=128, mode="GCM")],
    "node-rsa": [call("()", "RSA", size_at="0.b")],
    "@simplewebauthn/server": [call("verifyRegistrationResponse", "Signature", note="key-decides"), call("verifyAuthenticationResponse", "Signature", note="key-decides")],
    "otplib": [call("authenticator", "HMAC"), call("totp", "HMAC"), call("hotp", "HMAC")],
    "speakeasy": [call("totp", "HMAC"), call("hotp", "HMAC")],
    "cookie-signature": [call("sign", "HMAC", hash="SHA-256"), call("unsign", "HMAC", hash="SHA-256")],
    "keygrip": [call("()", "HMAC")],
    "@hpke/core": [
        call("DhkemX25519HkdfSha256", "HPKE DHKEM", curve="X25519", name="HPKE DHKEM(X25519)"), call("DhkemP256HkdfSha256", "HPKE DHKEM", curve="P-256", name="HPKE DHKEM(P-256)"),
        call("DhkemP384HkdfSha384", "HPKE DHKEM", curve="P-384", name="HPKE DHKEM(P-384)"), call("DhkemP521HkdfSha512", "HPKE DHKEM", curve="P-521", name="HPKE DHKEM(P-521)"),
        call("HkdfSha256", "HKDF", hash="SHA-256"), call("HkdfSha384", "HKDF", hash="SHA-384"), call("HkdfSha512", "HKDF", hash="SHA-512"),
        call("Aes128Gcm", "AES", bits=128, mode="GCM"), call("Aes256Gcm", "AES", bits=256, mode="GCM"),
    ],
    "@hpke/hybridkem-x-wing": [call("XWing", "Hybrid KEM", name="X-Wing")],
    "passport-saml": _SAML,
    "@node-saml/passport-saml": _SAML,
    "@node-saml/node-saml": [call("SAML", "Signature", name="SAML signature", note="key-decides")],
    "xml-crypto": [call("SignedXml", "Signature", name="XML signature", note="key-decides")],
    "xml-encryption": [call("encrypt", "RSA", name="RSA key transport (XML encryption)"), call("decrypt", "RSA", name="RSA key transport (XML encryption)")],
    "node-2fa": [call("generateToken", "HMAC", hash="SHA-1"), call("verifyToken", "HMAC", hash="SHA-1")],
}

#: Paths below a package whose export is the algorithm itself.
SUBPATHS = {
    "crypto-js": [
        call("aes", "AES"), call("des", "DES"), call("tripledes", "3DES"), call("rc4", "RC4"), call("md5", "Hash", hash="MD5"), call("sha1", "Hash", hash="SHA-1"),
        call("sha256", "Hash", hash="SHA-256"), call("sha512", "Hash", hash="SHA-512"), call("hmac-sha256", "HMAC", hash="SHA-256"), call("hmac-sha1", "HMAC", hash="SHA-1"),
        call("pbkdf2", "PBKDF2", iterations_at="2.iterations"),
    ],
}

#: Packages by whether they do post-quantum cryptography: no, yes, n/a where they have no public-key cryptography, check where it depends on use or version.
POST_QUANTUM = {
    "no": [
        "tweetnacl", "libsodium-wrappers", "libsodium-wrappers-sumo", "sodium-native", "@noble/curves", "@noble/ed25519", "@noble/secp256k1", "node-forge",
        "elliptic", "jsonwebtoken", "jws", "jwa", "fast-jwt", "express-jwt", "passport-jwt", "jwks-rsa", "jsrsasign", "@peculiar/webcrypto", "@peculiar/x509",
        "eth-crypto", "secp256k1", "web-push", "http_ece", "node-rsa", "@simplewebauthn/server", "@hpke/core", "passport-saml", "@node-saml/passport-saml",
        "@node-saml/node-saml", "xml-crypto", "xml-encryption",
    ],
    "n/a": [
        "@noble/hashes", "@noble/ciphers", "bcrypt", "bcryptjs", "argon2", "scrypt-js", "hash-wasm", "crypto-js", "otplib", "speakeasy", "cookie-signature",
        "keygrip", "express-session", "cookie-session", "node-2fa",
    ],
    "yes": [
        "@noble/post-quantum", "mlkem", "@hpke/ml-kem", "crystals-kyber-js", "pqc-kyber", "@hpke/hybridkem-x-wing",
    ],
    "check": [
        "jose", "openid-client", "openpgp", "ssh2",
    ],
}

#: Members that are hashes under their own names, by package. Fixed values.
HASH_MEMBERS = {
    "@noble/hashes": "sha1 md5 ripemd160 sha224 sha256 sha384 sha512 sha512_256 sha3_256 sha3_512 keccak_256 blake2b blake2s blake3",
    "hash-wasm": "md5 sha1 sha256 sha512 blake3", "crypto-js": "MD5 SHA1 SHA224 SHA256 SHA384 SHA512 RIPEMD160", "node-forge": "md.sha1 md.md5 md.sha256 md.sha384 md.sha512",
}

#: Curve objects of one package, each with sign, verify and getSharedSecret. Fixed values.
CURVE_MEMBERS = {"@noble/curves": "secp256k1 p256 secp256r1 p384 secp384r1 p521 secp521r1"}

#: Packages that take JSON Web Algorithm names; members that do no cryptography. Fixed values.
JOSE = ["jsonwebtoken", "jose", "jws", "jwa", "fast-jwt", "express-jwt", "passport-jwt", "jsrsasign", "jwks-rsa", "openid-client"]
PLAIN = {"jsonwebtoken": ["decode"], "jose": ["decodeJwt", "decodeProtectedHeader", "base64url", "errors"], "jws": ["decode"], "fast-jwt": ["createDecoder"], "passport-jwt": ["ExtractJwt"]}
