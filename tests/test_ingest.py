"""Provider files written by the test itself, read back as canonical rows."""

import pytest

from weftline.sources import bank as bk
from weftline.sources import calls as cl
from weftline.sources import folder as fd
from weftline.sources.delimited import read_texts

VVM = '''Input Value (MSISDN/IMEI),9876543210
Date Range,2024-01-01 to 2024-01-31
Calling Party Telephone Number,Called Party Telephone Number,Call Date,Call Time,Call Duration,Call Type,First Cell ID,Last Cell ID,IMEI,IMSI,Roaming Circle Name,LRN Called No
="9876543210",="9123456780",05/01/2024,10:11:12,65,outgoing,C1,C2,'356000000000001','404000000000001',Delhi,1
="9123456780",="9876543210",06/01/2024,11:00:00,-,incoming sms,C3,C4,356000000000001,404000000000001,"Delhi, NCR",1
'''
AIRTEL = '''Bharti Airtel Limited
Call Details of Mobile No '9000000001' PAN INDIA
Target No,B Party No,Date,Time,Dur(s),Call Type,Service Type,First CGI,Last CGI,IMEI,IMSI,Roam Nw,SW & MSC ID,LRN No,LRN TSP-LSA
9000000001,9000000002,01/02/2024,09:00:00,30,IN,Voice,A,B,1,2,Mumbai,M,L,T
9000000001,9000000003,01/02/2024,09:05:00,0,SMT,SMS,A,B,1,2,Mumbai,M,L,T
'''
BANK = '''Account statement,,,,,,
Date,Time,Narration,Debit,Credit,Balance,Account_No
05/01/2024,10:30:00,"UPI/P2A/401234567890/RAVI K/ravi@okaxis 9812345678","1,500.00",,8500.00,1234567890
06/01/2024,,NEFT/ABCD12345678 UTR: AXISN0123456789,,2500,11000,1234567890
'''
LINES = '''Statement of Account
Account No: 123456789012 IFSC: HDFC0001234
Opening Balance
Date Narration Balance
01/01/2024 UPI/PAY/RAVI 500.00 500.00
continued text here
02/01/2024 ATM WITHDRAWAL 200.00 300.00
03/01/2024 CARD PURCHASE 50.00 0.00 250.00
'''
COMPLAINTS = '''Acknowledgement no,Account No,IFSC Code,State,District,police Station,Mobile
ACK1,'1234567890',hdfc0001234,Gujarat,Surat,City PS,9812345678
'''
SDR = '''MSISDN,First Name,Last Name,Father Name,Subscriber Address1,Subscriber Address2,Circle Id,Service Type,Sim Type,Dealer Retailer Code,Mobile IMSI,Activation Date
9876543210,ASHA,RAO,B,House 1,Surat,GJ,Prepaid,pre,7,404000000000009,05/01/2020
'''
JIO6 = '''Report
Landline/MSISDN/MDN/Leased Circuit ID for Internet Access,User Id for internet Access based on authentication,Source MAC-ID Address/Other device Identification number,Source IP Address (IP Address Assigned/Translated),Public IP Address,Destination IP Address,Destination Port,Static/Dynamic IP Address Allocation,IST Start Time of Public IP address allocation (hh:mm:ss),IST End Time of Public IP address allocation (hh:mm:ss),Start Date of Public IP Address allocation (dd/mm/yyyy),IMEI,IMSI,CGI ID,Access Point Name,Session Duration,Data Volume Up Link,Data Volume Down Link,Roaming Circle
9876543210,u@jio,aa:bb,10.0.0.1,49.1.2.3,8.8.8.8,443,Dynamic,10:00:00,10:05:00,05/01/2024,356000000000001,404000000000001,CG1,jionet,300,10,20,Gujarat
'''
PLAIN_IP = '''Source IP,Destination IP,Start Date,Start Time,Destination Port,End Time
10.0.0.7,8.8.4.4,2024-01-05,11:00:00,80,11:01:00
not an address,8.8.4.4,2024-01-05,11:00:00,80,
'''
NODAL = '''Search Criteria : MSISDN
Search Value : 9876543210
SL_NO,Mobile_No,Other_Party_No,Call_Type,Service_Type,Call_Date,Call_Initiation_Time(CIT),Call_Duration,First_Cell_id,Last_Cell_ID,IMEI,IMSI
1,9876543210,9123456780,CALL_OUT,VOICE,05-Jan-2024,10:00:00,12,A,B,356000000000001,404000000000001
'''
VI = '''Vodafone Idea Call Data Records
MSISDN : - 9876543210
Target /A PARTY NUMBER,B PARTY NUMBER,CALL_TYPE,Service Type,Call date,Call Initiation Time,Call Duration,First Cell Global Id,Last Cell Global Id,IMEI,IMSI
9876543210,9123456780,INCOMING,VOICE,05/01/2024,10:00:00,7,A,B,356000000000001,404000000000001
'''
SYN_BANK = '''Transaction_ID,Date,Timestamp,Transaction_Mode,Transaction_Amount,Sender_Customer_ID,Sender_Customer_Name,Sender_Bank_Name,Sender_Account_Number,Sender_IFSC,Sender_Phone_Number,Receiver_Customer_Name,Receiver_Bank_Name,Receiver_Account_Number,Receiver_Phone_Number
T1,2024-01-05,10:30:00,upi,1500,C1,ASHA,HDFC,111,HDFC0001,9876543210,RAVI,SBI,222,9123456780
T2,2024-01-06,10:30:00,neft,900,C1,ASHA,HDFC,111,HDFC0001,9876543210,RAVI,SBI,222,9123456780
'''
SYN_CDR = '''CDR_ID,Operator,A_Party_Number,B_Party_Number,Call_Type,Call_Date,Call_Start_Time,Call_Duration_Seconds,IMSI,IMEI,First_Cell_Global_ID,First_BTS_Location,Roaming_Network_Circle
K1,Jio,9876543210,9123456780,OUT,2024-01-05,10:29:00,30,404000000000001,356000000000001,C1,Surat,Gujarat
'''
SYN_IPDR = '''IPDR_ID,Operator,Subscriber_MSISDN,Subscriber_IMSI,Device_IMEI,Source_IP_Address,Destination_IP_Address,Destination_Port,Cell_Global_ID,Session_Date,Session_Start_Time,Session_Duration_Seconds
P1,Jio,9876543210,404000000000001,356000000000001,10.0.0.1,8.8.8.8,443,C1,2024-01-05,10:28:00,60
'''
TRUTH = '''Anomaly_ID,Transaction_ID,IPDR_IDs,Scenario_Type,Source_Scope,Is_Suspicious,customer_id,cdr_ids,difficulty
A1,T1,P1;P2,mule,bank_cdr_ipdr,1,C1,K1;K2,hard
A2,T2,,mule,bank,0,C1,,easy
'''
PAIRS = '''Transaction_ID,CDR_ID,Time_Difference_Seconds,Is_Correlated
T1,K1,-60,1
T2,K1,90,0
'''


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("case")
    for name, text in (("vvm.csv", VVM), ("airtel.csv", AIRTEL), ("bank.csv", BANK), ("lines.txt", LINES), ("ncrp.csv", COMPLAINTS), ("sdr.csv", SDR), ("photo.png", "x"), ("jio6.csv", JIO6), ("ip.csv", PLAIN_IP), ("nodal.csv", NODAL), ("vi.csv", VI),
                       ("note.txt", "nothing to see")):
        (d / name).write_text(text)
    return str(d)


def test_calls_are_read_and_oriented(spark, folder):
    rows = cl.load_calls(spark, folder + "/vvm.csv", "jio_vvm").orderBy("line").collect()
    assert [(r.a_number, r.b_number, r.call_type, r.duration_sec) for r in rows] == [
        ("919876543210", "919123456780", "OUT", 65), ("919876543210", "919123456780", "SMS", 0)]
    assert rows[0].imei == "356000000000001" and rows[0].ts == 1704449472 and rows[1].roaming_circle == "Delhi, NCR"
    air = cl.load_calls(spark, folder + "/airtel.csv", "airtel").orderBy("line").collect()
    assert [(r.call_type, r.date, r.query_value) for r in air] == [("IN", "2024-02-01", "9000000001"), ("SMS", "2024-02-01", "9000000001")]


def test_tabular_bank(spark, folder):
    rows = bk.normalise(bk.read_tabular(read_texts(spark, folder + "/bank.csv"))).orderBy("date").collect()
    a, b = rows
    assert (a.debit, a.txn_type, a.mode, a.upi_id, a.counterparty_name, a.receiver_phone) == (1500.0, "D", "UPI", "ravi@okaxis 9812345678", "RAVI K", "919812345678")
    assert (b.credit, b.txn_type, b.mode, b.receiver_account, b.upi_ref) == (2500.0, "C", "NEFT", "ABCD12345678", "AXISN0123456789")


def test_statement_lines_follow_the_balance(spark, folder):
    rows = bk.read_lines(read_texts(spark, folder + "/lines.txt")).orderBy("line").collect()
    assert [(r.debit, r.credit, r.balance) for r in rows] == [(0.0, 500.0, 500.0), (200.0, 0.0, 300.0), (50.0, 0.0, 250.0)]
    assert rows[0].narration.endswith("continued text here") and rows[0].family == "hdfc" and rows[0].account_no == "123456789012"


def test_sessions_of_both_layouts(spark, folder):
    row = cl.read_provider_sessions(read_texts(spark, folder + "/jio6.csv")).first()
    assert (row.msisdn, row.source_ip, row.public_ip, row.dest_port, row.mac, row.apn, row.user_id, row.cell_id) == ("919876543210", "10.0.0.1", "49.1.2.3", "443", "aa:bb", "jionet", "u@jio", "CG1")
    assert (row.date, row.start_time, row.end_time, row.duration_sec, row.volume_up, row.roaming_circle, row.is_static) == ("2024-01-05", "10:00:00", "10:05:00", 300, 10, "Gujarat", "Dynamic")
    assert row.end_ts - row.start_ts == 300
    plain = cl.read_plain_sessions(read_texts(spark, folder + "/ip.csv")).collect()
    assert [(r.source_ip, r.dest_ip, r.date, r.start_time, r.end_ts - r.start_ts, r.msisdn) for r in plain] == [("10.0.0.7", "8.8.4.4", "2024-01-05", "11:00:00", 60, None)]


def test_nodal_and_vi_calls(spark, folder):
    for name, layout, seconds, kind in (("nodal", "jio_nodal", 12, "OUT"), ("vi", "vi", 7, "IN")):
        row = cl.load_calls(spark, f"{folder}/{name}.csv", layout).first()
        assert (row.a_number, row.b_number, row.call_type, row.date, row.duration_sec, row.query_value) == ("919876543210", "919123456780", kind, "2024-01-05", seconds, "9876543210")


def test_subscribers_have_a_header_and_a_value_line(spark, folder):
    row = cl.read_subscribers(read_texts(spark, folder + "/sdr.csv")).first()
    assert (row.msisdn, row.subscriber_name, row.address, row.circle, row.connection_type, row.imsi, row.activation_date) == (
        "919876543210", "ASHA RAO", "House 1 Surat", "GJ", "Prepaid", "404000000000009", "2020-01-05")
    assert row.raw_meta.startswith("father name=B; activation date=05/01/2020; sim type=pre")


def test_synthetic_folder_with_its_labels(spark, tmp_path):
    for name, text in (("bank_anomaly.csv", SYN_BANK), ("cdr_anomaly.csv", SYN_CDR), ("ipdr_anomaly.csv", SYN_IPDR), ("anomaly.csv", TRUTH), ("bank_cdr.csv", PAIRS)):
        (tmp_path / name).write_text(text)
    got = fd.ingest(spark, str(tmp_path))
    bank = got.case.bank.orderBy("txn_id").collect()
    assert [(r.txn_id, r.debit, r.mode, r.account_no, r.receiver_account, r.sender_phone) for r in bank] == [("T1", 1500.0, "UPI", "111", "222", "919876543210"), ("T2", 900.0, "NEFT", "111", "222", "919876543210")]
    assert (got.case.cdr.first().cdr_id, got.case.ipdr.first().ipdr_id, got.case.ipdr.first().end_ts - got.case.ipdr.first().start_ts) == ("K1", "P1", 60)
    assert {r.file.rsplit("/", 1)[1]: (r.status, r.records) for r in got.status.collect()} == {
        "bank_anomaly.csv": ("ok", 2), "cdr_anomaly.csv": ("ok", 1), "ipdr_anomaly.csv": ("ok", 1), "anomaly.csv": ("ground_truth", 0), "bank_cdr.csv": ("ground_truth", 0)}
    truth = got.suspicious.collect()
    assert [(r.anomaly_id, r.transaction_id, r.ipdr_ids, r.cdr_ids, r.scope, r.customer_id, r.difficulty) for r in truth] == [("A1", "T1", ["P1", "P2"], ["K1", "K2"], "bank_cdr_ipdr", "C1", "hard")]
    assert [tuple(r) for r in got.bank_calls.collect()] == [("T1", "K1", 60)] and got.calls_sessions.count() == 0


def test_cases_and_users_are_kept_apart(spark, tmp_path):
    from weftline.case import Case

    one = lambda **c: spark.createDataFrame([tuple(c.values())], list(c))
    wide, narrow = one(id="1", extra="x"), one(id="2")
    fd.save_case(Case(wide, wide, wide, wide, wide), str(tmp_path), "c1", "ann")
    fd.save_case(Case(narrow, narrow, narrow, narrow, narrow), str(tmp_path), "c1", "bob")
    fd.save_case(Case(narrow, narrow, narrow, narrow, narrow), str(tmp_path), "c2", "ann")
    assert fd.load_case(spark, str(tmp_path), "c1", "ann").bank.collect() == wide.collect()
    assert fd.load_case(spark, str(tmp_path), "c1", "bob").bank.collect() == narrow.collect() and fd.load_case(spark, str(tmp_path), "c2", "ann").cdr.columns == ["id"]


def test_folder_ingest_status_and_storage(spark, folder, tmp_path):
    got = fd.ingest(spark, folder)
    rows = got.status.collect()
    status = {r.file.rsplit("/", 1)[1]: (r.status, r.records) for r in rows}
    assert {r.file.rsplit("/", 1)[1]: r.format for r in rows if r.records} == {
        "vvm.csv": "jio_vvm", "airtel.csv": "airtel", "bank.csv": "bank_csv", "lines.txt": "bank_pdf", "ncrp.csv": "ncrp_complaints", "sdr.csv": "airtel_sdr", "jio6.csv": "jio_ipv6", "ip.csv": "ipdr_csv", "nodal.csv": "jio_nodal", "vi.csv": "vi"}
    assert status["photo.png"][0] == "unsupported_type" and status["note.txt"][0] == "no_match"
    assert status["vvm.csv"] == ("ok", 2) and status["airtel.csv"] == ("ok", 2) and status["bank.csv"] == ("ok", 2)
    assert status["lines.txt"] == ("ok", 3) and status["ncrp.csv"] == ("ok", 1) and status["sdr.csv"] == ("ok", 1)
    fd.save_case(got.case, str(tmp_path / "store"), "c1")
    back = fd.load_case(spark, str(tmp_path / "store"), "c1")
    assert (back.bank.count(), back.cdr.count(), back.complaints.first().account_no, back.subscribers.first().address) == (5, 6, "1234567890", "House 1 Surat")
