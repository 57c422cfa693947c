"""Payload templates. Placeholders in braces are filled per row by ``plans.payloads``.

{nik} {nama} {telepon} {jabatan} {lokasi} are the fields of the person, with _q percent-encoded;
{nama2} {nik2} a second person; {num15} {num16} {num17} digit runs that are no ID; {amount} a
number with thousands commas; {rec} a record number; {ts} {date} times; {level} a log level.
"""

# Fixed values: (set, kind, format stored, category stored or None, holds personal data).
KINDS = [
    ("main", "json", "json", None, True),
    ("main", "formdata", "formdata", None, True),
    ("main", "narrative", "narrative", None, True),
    ("main", "neg_json", "json", None, False),
    ("main", "neg_formdata", "formdata", None, False),
    ("main", "neg_narrative", "narrative", None, False),
    ("adversarial", "fp_json", "json", "context_free_16digit", False),
    ("adversarial", "fp_formdata", "formdata", "context_free_16digit", False),
    ("adversarial", "fp_narrative", "narrative", "context_free_16digit", False),
    ("adversarial", "amounts", "narrative", None, False),
    ("adversarial", "oov_job_json", "json", None, True),
    ("adversarial", "oov_job_formdata", "formdata", None, True),
    ("adversarial", "oov_job_narrative", "narrative", None, True),
    ("adversarial", "oov_place", "narrative", None, True),
    ("adversarial", "url", "narrative", None, True),
    ("adversarial", "xml", "narrative", None, True),
    ("adversarial", "sql", "narrative", None, True),
    ("adversarial", "typo", "narrative", None, True),
    ("adversarial", "bilingual", "narrative", None, True),
    ("holdout", "email_sig", "email_signature", None, True),
    ("holdout", "db_export", "database_export", None, True),
    ("holdout", "cs_log", "cs_log", None, True),
    ("holdout", "gov_letter", "gov_letter", None, True),
    ("holdout", "json_log", "json_log", None, True),
    ("holdout", "tabular", "tabular", None, True),
    ("holdout", "multi_context", "multi_context", None, True),
    ("hard", "context_free_16digit", "hard_adversarial", "context_free_16digit", False),
    ("hard", "nik_unusual_context", "hard_adversarial", "nik_unusual_context", True),
    ("hard", "nested_pii", "hard_adversarial", "nested_pii", True),
    ("hard", "near_pattern", "hard_adversarial", "near_pattern", False),
]

# Percent of rows per kind, in order, for each set.
QUOTAS = {
    "main": [
        ("json", 40), ("formdata", 40), ("narrative", 15),
        ("neg_json", 2), ("neg_formdata", 1), ("neg_narrative", 2),
    ],
    "adversarial": [
        ("fp_json", 5), ("fp_formdata", 5), ("fp_narrative", 5), ("amounts", 15),
        ("oov_job_json", 5), ("oov_job_formdata", 5), ("oov_job_narrative", 5),
        ("oov_place", 15), ("url", 7), ("xml", 7), ("sql", 6), ("typo", 10), ("bilingual", 10),
    ],
    "holdout": [
        ("email_sig", 15), ("db_export", 15), ("cs_log", 15), ("gov_letter", 15),
        ("json_log", 15), ("tabular", 15), ("multi_context", 10),
    ],
    "hard": [
        ("context_free_16digit", 25), ("nik_unusual_context", 25),
        ("nested_pii", 25), ("near_pattern", 25),
    ],
}

# Payload templates per kind.
TEMPLATES = {
    "json": [
        '{"nik": "{nik}", "nama": "{nama}", "telepon": "{telepon}", "jabatan": "{jabatan}", "kota": "{lokasi}"}',
        '{"user": {"id": "{nik}", "fullName": "{nama}", "phone": "{telepon}"}, "position": "{jabatan}", "location": "{lokasi}"}',
        '{"identity_number": "{nik}", "full_name": "{nama}", "phone_number": "{telepon}", "job_title": "{jabatan}", "city": "{lokasi}"}',
        '{"data": {"personal": {"name": "{nama}", "nik": "{nik}"}, "contact": "{telepon}", "work": {"position": "{jabatan}", "office_location": "{lokasi}"}}}',
    ],
    "formdata": [
        "nik={nik}&nama={nama_q}&telepon={telepon}&jabatan={jabatan_q}&kota={lokasi_q}",
        "nomor_induk={nik}&nama_lengkap={nama_q}&nomor_hp={telepon}&posisi={jabatan_q}&wilayah={lokasi_q}",
        "id={nik}&name={nama_q}&phone={telepon}&position={jabatan_q}&location={lokasi_q}",
        "identitas={nik}&fullname={nama_q}&kontak={telepon}&jabatan={jabatan_q}&lokasi={lokasi_q}",
        "nik={nik}&nm={nama_q}&hp={telepon}&jab={jabatan_q}&kt={lokasi_q}",
        "nama={nama_q}&nik={nik}&jabatan={jabatan_q}&kota={lokasi_q}&telepon={telepon}",
    ],
    "narrative": [
        "Permohonan akses untuk {nama} dengan NIK {nik} sebagai {jabatan} di {lokasi}. Kontak: {telepon}",
        "Data pegawai: {nama}, NIK {nik}, menjabat sebagai {jabatan} di wilayah {lokasi}, telepon {telepon}",
        "{nama} ({nik}) mengajukan izin cuti. Jabatan: {jabatan}, Lokasi: {lokasi}, HP: {telepon}",
        "Surat keterangan untuk {nama} dengan nomor identitas {nik} yang bertugas di {lokasi} sebagai {jabatan}. Nomor kontak: {telepon}",
        "Berdasarkan data pegawai, {nama} dengan NIK {nik} ditugaskan di {lokasi} dengan jabatan {jabatan}. Nomor HP: {telepon}",
        "Yang bertanda tangan di bawah ini, {nama}, NIK {nik}, {jabatan} di {lokasi}, dengan ini menyatakan. Kontak: {telepon}",
        "Mohon diverifikasi data berikut: Nama {nama}, NIK {nik}, Jabatan {jabatan}, Wilayah {lokasi}, Telepon {telepon}",
    ],
    "neg_json": [
        '{"status": "success", "message": "Sistem diperbarui", "code": 200}',
        '{"server_uptime": "99.9%", "active_users": {rec}}',
        '{"config": {"firewall": "updated", "port": 8080}}',
        '{"transaction_summary": {"total_sales": 5000000, "currency": "IDR"}}',
    ],
    "neg_formdata": [
        "action=update&status=success&timestamp={rec}",
        "setting=network&firewall=enabled&port=443",
        "query=dashboard&metrics=users&count={rec}",
    ],
    "neg_narrative": [
        "Sistem berhasil diperbarui pada tanggal 15 Januari 2026",
        "Rapat koordinasi akan dilaksanakan di ruang meeting lantai 3",
        "Status server: online. Uptime: 99.9%",
        "Backup database selesai pada pukul 03:00 dini hari",
        "Konfigurasi firewall telah diperbarui dengan kebijakan terbaru",
    ],
    "fp_json": [
        '{"event": "checkout", "order_id": "{num16}", "status": "success"}',
        '{"transaction": {"id": "{num16}", "amount": 5000000}}',
        '{"log_data": {"session_id": "{num16}", "action": "login"}}',
        '{"api_response": {"reference_number": "{num16}", "code": 200}}',
    ],
    "fp_formdata": [
        "order_id={num16}&status=success&amount=5000000",
        "trx_id={num16}&payment_method=transfer",
        "session={num16}&action=checkout",
        "ref_num={num16}&callback=true",
    ],
    "fp_narrative": [
        "Order ID: {num16} sudah berhasil diproses dan akan dikirim",
        "Nomor invoice {num16} telah diterima sistem",
        "Transaction ID: {num16} confirmed",
        "Reference number: {num16} for your booking",
        "Serial number perangkat: {num16}",
    ],
    "amounts": [
        "Saldo akhir: Rp {amount}",
        "Total transaksi: Rp {amount}",
        "Tagihan listrik bulan ini: Rp {amount}",
        "Harga produk: Rp {amount}",
        "Limit kartu kredit: Rp {amount}",
        "Jumlah bantuan sosial: Rp {amount}",
        "Anggaran tahunan: Rp {amount}",
        "Dana cadangan: Rp {amount}",
    ],
    "oov_job_json": [
        '{"nik": "{nik}", "nama": "{nama}", "telepon": "{telepon}", "jabatan": "{jabatan}", "kota": "{lokasi}"}',
    ],
    "oov_job_formdata": [
        "nik={nik}&nama={nama_q}&telepon={telepon}&jabatan={jabatan_q}&kota={lokasi_q}",
    ],
    "oov_job_narrative": [
        "Permohonan dari {nama} (NIK: {nik}) sebagai {jabatan} yang berbasis di {lokasi}. Kontak: {telepon}",
        "Data karyawan {nama} dengan NIK {nik} bekerja sebagai {jabatan} di kantor {lokasi}. HP: {telepon}",
    ],
    "oov_place": [
        "Konsulat Jenderal RI: {nama} ({nik}) bertugas sebagai {jabatan} di {lokasi}. Telp: {telepon}",
        "Atase {jabatan} {nama} (NIK: {nik}) ditempatkan di {lokasi}. Kontak: {telepon}",
        '{"nama_lengkap": "{nama}", "nik": "{nik}", "jabatan": "{jabatan}", "lokasi_tugas": "{lokasi}", "telepon": "{telepon}"}',
    ],
    "url": [
        "https://example.com/api/user?nik={nik}&phone={telepon}&name={nama_q}",
        "GET /api/v1/users/{nik}?phone={telepon}",
        "https://gov-id.example.com/citizen?id={nik}&name={nama_q}&contact={telepon}",
    ],
    "xml": [
        "<user><nik>{nik}</nik><name>{nama}</name><phone>{telepon}</phone></user>",
        "<citizen id='{nik}'><name>{nama}</name><position>{jabatan}</position><city>{lokasi}</city></citizen>",
        "<form><field name='nik'>{nik}</field><field name='nama'>{nama}</field><field name='telepon'>{telepon}</field></form>",
    ],
    "sql": [
        "INSERT INTO users (nik, nama, phone) VALUES ('{nik}', '{nama}', '{telepon}')",
        "UPDATE citizens SET name='{nama}', phone='{telepon}' WHERE nik='{nik}'",
        "SELECT * FROM employees WHERE nik = '{nik}' AND nama LIKE '%{nama}%'",
    ],
    "typo": [
        "Nama: {nama}, Nik: {nik}, Tlp: {telepon}, Jbtn: {jabatan}, Kot: {lokasi}",
        "nm={nama}; nik={nik}; hp={telepon}; jbt={jabatan}; kt={lokasi}",
        "NIK milik {nama} (NIK: {nik}), Hp: {telepon}, Jabatan: {jabatan}, di {lokasi}",
        "Pegawai {nama}, NIK {nik}, telp {telepon}, ditugaskan di {lokasi} sbg {jabatan}",
        "Permintaan dari {nama} dgn NIK {nik}. Kontak {telepon}. Posisi {jabatan} di {lokasi}",
    ],
    "bilingual": [
        "Employee data: Name {nama}, NIK {nik}, Position {jabatan}, Office {lokasi}, Mobile {telepon}",
        "Permintaan registration untuk user {nama} (NIK: {nik}) sebagai {jabatan} di {lokasi}, contact {telepon}",
        "User registration form: nama={nama}, identity_number={nik}, role={jabatan}, branch={lokasi}, phone={telepon}",
    ],
    "email_sig": [
        "Hormat saya,\n\n{nama}\n{jabatan}\nKantor: {lokasi}\nNIK: {nik}\nHP: {telepon}",
        "Best regards,\n\n{nama} | {jabatan}\nLokasi: {lokasi}\nID: {nik}\nMobile: {telepon}",
        "Salam hangat,\n{nama}\nNIK: {nik}\n{jabatan} - {lokasi}\nTelepon: {telepon}",
        "Terima kasih,\n\n{nama} ({jabatan})\n📧 NIK: {nik}\n📱 {telepon}\n📍 {lokasi}",
    ],
    "db_export": [
        "{rec},{nik},{nama},{jabatan},{lokasi},{telepon}",
        "{rec}|{nik}|{nama}|{jabatan}|{lokasi}|{telepon}",
        "INSERT INTO pegawai (id, nik, nama, jabatan, lokasi, telepon) VALUES ({rec}, '{nik}', '{nama}', '{jabatan}', '{lokasi}', '{telepon}');",
        "[{ts}] DB_INSERT: id={rec}; nik={nik}; nama={nama}; jabatan={jabatan}; lokasi={lokasi}; telepon={telepon}",
    ],
    "cs_log": [
        "[{ts}] CS_AGENT: Validasi pelanggan - Nama: {nama}, NIK: {nik}, HP: {telepon}, Lokasi: {lokasi}, Jabatan: {jabatan}",
        "[{ts}] LOG: Pelanggan {nama} (NIK: {nik}) menelepon dari nomor {telepon}. Domisili: {lokasi}. Profesi: {jabatan}.",
        "TICKET #{rec} - {ts}\nPelanggan: {nama}\nNIK: {nik}\nKontak: {telepon}\nKota: {lokasi}\nJabatan: {jabatan}",
        "<{ts}> Helpdesk berbicara dengan {nama} (HP {telepon}, NIK {nik}, {jabatan} di {lokasi})",
    ],
    "gov_letter": [
        "Yang bertanda tangan di bawah ini:\n\nNama         : {nama}\nNIK          : {nik}\nJabatan      : {jabatan}\nWilayah Kerja: {lokasi}\nNo. Telepon  : {telepon}\n\ndengan ini menyatakan...",
        "Surat Keterangan No. {rec}/SK/2026\n\nKepala kantor menerangkan bahwa {nama} dengan NIK {nik} adalah benar bertugas sebagai {jabatan} di {lokasi}. Yang bersangkutan dapat dihubungi pada nomor {telepon}.",
        "PERMOHONAN AKSES SISTEM\n\nDari   : {nama}\nNIK    : {nik}\nUnit   : {jabatan}\nKantor : {lokasi}\nKontak : {telepon}\n\nMemohon akses sistem informasi kepegawaian.",
        "BERITA ACARA - Pelaksanaan kegiatan dilakukan oleh Sdr/i {nama} (NIK: {nik}) selaku {jabatan} pada wilayah kerja {lokasi}. Untuk koordinasi lebih lanjut, dapat menghubungi {telepon}.",
    ],
    "json_log": [
        '{"timestamp": "{ts}", "level": "{level}", "service": "user-service", "event": "user_registration", "user": {"nik": "{nik}", "name": "{nama}", "phone": "{telepon}", "position": "{jabatan}", "location": "{lokasi}"}}',
        '{"@timestamp": "{ts}", "log_type": "audit", "action": "data_access", "actor": {"name": "{nama}", "id": "{nik}", "phone": "{telepon}"}, "metadata": {"department": "{jabatan}", "office": "{lokasi}"}}',
        '{"ts":"{ts}","msg":"User profile updated","data":{"nik":"{nik}","nama":"{nama}","hp":"{telepon}","jbt":"{jabatan}","kt":"{lokasi}"}}',
    ],
    "tabular": [
        "nama,nik,telepon,jabatan,lokasi\n{nama},{nik},{telepon},{jabatan},{lokasi}",
        "nama\tnik\ttelepon\tjabatan\tlokasi\n{nama}\t{nik}\t{telepon}\t{jabatan}\t{lokasi}",
        "nama|nik|telepon|jabatan|lokasi\n{nama}|{nik}|{telepon}|{jabatan}|{lokasi}",
        "| Nama | NIK | Telepon | Jabatan | Lokasi |\n|------|-----|---------|---------|--------|\n| {nama} | {nik} | {telepon} | {jabatan} | {lokasi} |",
    ],
    "multi_context": [
        "Mohon konfirmasi dari {nama} (NIK: {nik}, HP: {telepon}) selaku {jabatan} di {lokasi}, mengenai permohonan akses dari {nama2} dengan NIK {nik2}.",
        "Komunikasi internal: {jabatan} {nama} di {lokasi} (kontak {telepon}, NIK {nik}) telah menyetujui permintaan dari rekan kerja.",
        "Dalam meeting koordinasi, {nama} (NIK {nik}) sebagai {jabatan} dari {lokasi} menyampaikan laporan. Beliau dapat dihubungi di {telepon} untuk keperluan tindak lanjut.",
    ],
    "context_free_16digit": [
        "{num16} - data record",
        "Code {num16} verified",
        "Status: {num16} active",
        "Reference {num16} acknowledged",
        "Entry {num16}",
        "Auth token: {num16}",
        "Session ID {num16}",
        "Hash value: {num16}",
        "UUID-like: {num16}",
        "{num16} dalam database",
    ],
    "nik_unusual_context": [
        "{nama} {nik}",
        "{nik} - {nama}",
        "Reg: {nik} | {nama}",
        "({nik}) {nama} telah terdaftar",
        "#{nik} {nama}",
    ],
    "nested_pii": [
        'metadata = {"timestamp": "{date}", "user": "{nama}", "id": "{nik}"}',
        "User-Agent: Mozilla/5.0 (X11; Linux) UserID:{nik} {nama}",
        "<event type='login'><user nik='{nik}'>{nama}</user><tel>{telepon}</tel></event>",
        "console.log('user', '{nama}', 'id', '{nik}');",
    ],
    "near_pattern": [
        "Almost NIK: {num15} (only 15 digits)",
        "Code {num15} - format mirip NIK tapi bukan",
        "ID {num15} (invalid format)",
        "Long number: {num17} (17 digits, too many)",
        "{num17} - tracking",
    ],
}

# Request bodies of the live check, in turn by request number.
REQUEST_BODIES = [
    ("json_simple", "application/json", '{"nama":"{nama}","nik":"{nik}","phone":"{telepon}"}'),
    ("json_nested", "application/json", '{"data":{"identitas":{"nik":"{nik}","nama":"{nama}"},"kontak":{"telepon":"{telepon}"}}}'),
    ("form", "application/x-www-form-urlencoded", "nama={nama}&nik={nik}&telepon={telepon}"),
    ("naratif", "text/plain", "Saudara {nama} dengan NIK {nik} dan nomor telepon {telepon} telah terdaftar."),
]
