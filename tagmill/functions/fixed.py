"""Word lists, code tables and patterns that results depend on."""

# Fixed values. Entity order is the labelling order: (field of the PII record, entity type).
ENTITY_FIELDS = [
    ("nik", "NIK"),
    ("telepon", "PHONE"),
    ("jabatan", "JABATAN"),
    ("lokasi", "LOKASI"),
    ("nama", "NAMA"),
]
ENTITY_TYPES = ["NIK", "PHONE", "NAMA", "JABATAN", "LOKASI"]

# Fixed values. Label sets: the strict one of the data checks, and the annotation guide's.
STRICT_LABELS = [
    "O", "B-NIK", "B-PHONE", "B-NAMA", "I-NAMA",
    "B-JABATAN", "I-JABATAN", "B-LOKASI", "I-LOKASI",
]
GUIDE_LABELS = STRICT_LABELS + ["I-NIK", "I-PHONE"]

# Fixed values. Patterns for whole tokens.
NIK_TOKEN = r"^\p{Nd}{16}$"
PHONE_TOKEN = r"^(?:\+62|0)\p{Nd}{8,12}$"
NIK_PLACEHOLDER = "<__NIK_PATTERN__>"
PHONE_PLACEHOLDER = "<__PHONE_PATTERN__>"
UNKNOWN_TOKEN = "<UNK>"

# Fixed values. Province codes of the national ID.
PROVINCES = {
    11: "Aceh",
    12: "Sumatera Utara",
    13: "Sumatera Barat",
    14: "Riau",
    15: "Jambi",
    16: "Sumatera Selatan",
    17: "Bengkulu",
    18: "Lampung",
    19: "Kepulauan Bangka Belitung",
    21: "Kepulauan Riau",
    31: "DKI Jakarta",
    32: "Jawa Barat",
    33: "Jawa Tengah",
    34: "DI Yogyakarta",
    35: "Jawa Timur",
    36: "Banten",
    51: "Bali",
    52: "Nusa Tenggara Barat",
    53: "Nusa Tenggara Timur",
    61: "Kalimantan Barat",
    62: "Kalimantan Tengah",
    63: "Kalimantan Selatan",
    64: "Kalimantan Timur",
    65: "Kalimantan Utara",
    71: "Sulawesi Utara",
    72: "Sulawesi Tengah",
    73: "Sulawesi Selatan",
    74: "Sulawesi Tenggara",
    75: "Gorontalo",
    76: "Sulawesi Barat",
    81: "Maluku",
    82: "Maluku Utara",
    91: "Papua",
    94: "Papua Barat",
}

# Fixed values. Accepted phone prefixes: four characters of 0..., five of +62...
PHONE_PREFIXES = [
    "0811", "0812", "0813", "0814", "0815", "0816", "0817", "0818", "0819",
    "0821", "0822", "0823", "0851", "0852", "0853", "0855", "0856", "0857", "0858",
    "+6281", "+6282", "+6285", "+6287",
]

# Fixed values. Title markers looked for inside a token.
TITLE_MARKERS = ["S.", "M.", "Dr.", "Drs.", "Hj.", "H.", "Ir.", "Prof.", "Ph.D"]

# Fixed values. Delimiters skipped once when looking for the word before a value.
VALUE_DELIMITERS = [":", "=", '"', "'", "|", ","]

# Fixed values. Gazetteer seeds.
JABATAN_PREFIX = [
    "kepala", "wakil", "asisten", "sekretaris", "kepala bagian",
    "kepala dinas", "kepala bidang", "direktur",
]
NIK_LABEL_SEEDS = [
    "nik", "NIK", "Nik", "nomor_induk", "nomor", "induk", "no.nik", "no_nik", "id", "ID",
    "identity", "identification", "identity_number", "identitynumber", "idnumber",
    "id_number", "kependudukan", "ktp", "no_ktp", "noktp",
]
PHONE_LABEL_SEEDS = [
    "hp", "HP", "Hp", "telepon", "telp", "tlp", "tel", "phone", "mobile", "mobil",
    "cellular", "kontak", "contact", "nomor_telepon", "nomortelepon", "phone_number",
    "phonenumber", "no_hp", "nohp",
]
NEGATIVE_KEYWORDS = [
    "order", "invoice", "tracking", "receipt", "reference", "ref", "transaction",
    "transaksi", "booking", "reservation", "reservasi", "code", "kode", "serial",
    "session", "sesi", "auth", "token", "hash", "hashcode", "uuid", "guid", "log",
    "product", "produk", "item", "sku", "resi", "nomor_resi", "shipping", "amount",
    "jumlah", "total", "saldo", "rekening", "account", "bank", "tagihan", "biaya",
    "harga", "server", "service", "request", "api_key", "apikey", "key", "kunci",
]

# Fixed values. Words that show a logged ID was treated as personal data.
MASK_CONTEXT_WORDS = ["masked", "detected", "nik=", "b-nik"]

# Fixed values. Runs that part the request blocks of a log.
SEPARATOR = r"={50,}"

# Fixed values. Reasons of ID validation.
REASON_LENGTH = "Panjang bukan 16 digit atau bukan angka"
REASON_PROVINCE = "Kode provinsi %d tidak valid"
REASON_MONTH = "Bulan %d tidak valid (harus 1-12)"
REASON_DAY = "Tanggal %d tidak valid"
REASON_DATE = "Tanggal %d tidak valid untuk bulan %d tahun %d"

# Fixed values. Sample vocabulary for rendered payloads.
PERSON_NAMES = [
    "Budi Santoso", "Siti Rahayu", "Agus Wijaya", "Dewi Lestari", "Hendra Pratama",
    "Ratna Sari", "Rizki Aditya", "Putri Maharani", "Andi Saputra", "Maya Anggraini",
]
GOVERNMENT_JOBS = [
    "Kepala Dinas Pendidikan", "Kepala Dinas Kesehatan", "Kepala Dinas Sosial",
    "Kepala Dinas Pariwisata", "Kepala Dinas Perhubungan", "Sekretaris Daerah",
    "Asisten Sekretaris Daerah", "Camat", "Lurah", "Kepala Bagian Umum",
    "Kepala Bagian Hukum", "Kepala Bagian Keuangan", "Kepala Bidang Anggaran",
    "Kepala Bidang Kepegawaian", "Kepala Bidang Perencanaan",
    "Kepala Bidang Penanaman Modal", "Kepala Sub Bagian Keuangan",
    "Kepala Sub Bagian Umum", "Direktur Rumah Sakit Daerah", "Kepala Puskesmas",
    "Staf Administrasi Pemerintahan", "Staf Keuangan Daerah", "Bendahara Daerah",
    "Sekretaris Dinas",
]
PRIVATE_JOBS = [
    "Direktur Utama", "Manajer Operasional", "Project Manager", "HR Manager",
    "Kepala Cabang", "Supervisor Produksi", "Dosen Teknik Informatika",
    "Kepala Sekolah", "Software Engineer", "Data Analyst", "Account Executive",
    "Marketing Director",
]
HOME_LOCATIONS = [
    "Jakarta", "Bandung", "Surabaya", "Yogyakarta", "Semarang", "Medan", "Makassar",
    "Depok", "Bogor", "Tangerang", "Bekasi", "Palembang", "Denpasar", "Malang",
    "Padang", "Pekanbaru", "Banjarmasin", "Pontianak", "Manado", "Aceh", "Riau",
    "Lampung", "Bali", "Papua", "Jawa Barat", "Jawa Tengah", "Jawa Timur",
    "Sumatera Utara", "Kalimantan Selatan", "Sulawesi Selatan", "Banten",
    "Sumatera Barat", "Kalimantan Timur", "Sulawesi Utara",
]
FOREIGN_LOCATIONS = [
    "Singapore", "Malaysia", "Thailand", "Vietnam", "Filipina", "Tokyo", "Seoul",
    "Beijing", "Shanghai", "Hong Kong", "Sydney", "Melbourne", "London", "Paris",
    "Berlin", "New York", "San Francisco", "Los Angeles", "Toronto", "Dubai", "Doha",
    "Riyadh", "Mumbai", "Bangalore",
]
