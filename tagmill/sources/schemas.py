"""Fixed schemas of the tables that are read and written."""

PII = "struct<nik:string,nama:string,telepon:string,jabatan:string,lokasi:string>"
SAMPLES = f"sample_id bigint, payload string, format string, pii_data {PII}, source string, category string"
TAGGED = (
    "sample_id bigint, payload string, format string, tokens array<string>, labels array<string>, "
    "source string, split string"
)
ID_REFERENCE = "NIK string, Provinsi string, `Tanggal Lahir` string, `Jenis Kelamin` string, `Nomor Urut` string"
LOADTEST = (
    "timeStamp bigint, elapsed int, label string, responseCode int, responseMessage string, "
    "threadName string, dataType string, success boolean, failureMessage string, bytes int, "
    "sentBytes int, grpThreads int, allThreads int, URL string, Latency int, IdleTime int, Connect int"
)
ANNOTATION_TASKS = (
    "id bigint, inner_id bigint, data struct<text:string,meta_format:string>, "
    "annotations array<struct<completed_by:string, result:array<struct<type:string, "
    "value:struct<start:int,end:int,text:string,labels:array<string>>>>>>"
)
ROUND1 = (
    "round string, completed boolean, annotations array<struct<sample_id:bigint, format:string, "
    "NIK:array<string>, PHONE:array<string>, NAMA:array<string>, JABATAN:array<string>, "
    "LOKASI:array<string>, note:string>>"
)
PAYLOADS = (
    "id int, format string, nik_expected string, nama_expected string, phone_expected string, "
    "content_type string, body string"
)
HMM = {
    "start": "state string, logp double",
    "trans": "prev string, state string, logp double",
    "emission": "state string, token string, logp double",
    "unseen": "state string, logp double",
}
GAZETTEER = "category string, term string"
