"""Column lists and missing-value texts of the statements, written out here so that one forgotten
in the library is not forgotten on both sides.  Fixed values: they are the output contract."""

MISSING_TEXTS = ['', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN',
 '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null']

RAW_COLUMNS = ['company_name', 'team_id', 'is_test', 'region', 'snapshot_month', 'source_file', 'load_date',
 'total_clicks', 'total_clicks_wo_api', 'non_jobs_clicks', 'view_candidates', 'active_coddlers',
 'monthly_fee', 'monthly_fee_currency', 'number_candidate_emails', 'number_contact_emails',
 'salesperson', 'latest_contract_end_date', 'active_harvester_accounts', 'active_users',
 'total_resumes', 'total_jobs', 'hires_in_past_year']

VIEW_COLUMNS = {'clients_clean': ['company_name', 'team_id', 'is_test', 'region', 'snapshot_month',
                   'source_file', 'load_date', 'total_clicks', 'total_clicks_wo_api',
                   'non_jobs_clicks', 'view_candidates', 'active_coddlers', 'monthly_fee',
                   'monthly_fee_currency', 'number_candidate_emails', 'number_contact_emails',
                   'salesperson', 'latest_contract_end_date', 'active_harvester_accounts',
                   'active_users', 'total_resumes', 'total_jobs', 'hires_in_past_year'],
 'latest_snapshot': ['company_name', 'team_id', 'is_test', 'region', 'snapshot_month',
                     'source_file', 'load_date', 'total_clicks', 'total_clicks_wo_api',
                     'non_jobs_clicks', 'view_candidates', 'active_coddlers', 'monthly_fee',
                     'monthly_fee_currency', 'number_candidate_emails', 'number_contact_emails',
                     'salesperson', 'latest_contract_end_date', 'active_harvester_accounts',
                     'active_users', 'total_resumes', 'total_jobs', 'hires_in_past_year',
                     'company_size'],
 'previous_snapshot': ['company_name', 'team_id', 'is_test', 'region', 'snapshot_month',
                       'source_file', 'load_date', 'total_clicks', 'total_clicks_wo_api',
                       'non_jobs_clicks', 'view_candidates', 'active_coddlers', 'monthly_fee',
                       'monthly_fee_currency', 'number_candidate_emails',
                       'number_contact_emails', 'salesperson', 'latest_contract_end_date',
                       'active_harvester_accounts', 'active_users', 'total_resumes',
                       'total_jobs', 'hires_in_past_year'],
 'growth_summary': ['team_id', 'company_name', 'users_current', 'users_previous',
                    'users_change', 'clicks_current', 'clicks_previous', 'clicks_change',
                    'fee_current', 'fee_previous', 'fee_change', 'jobs_current',
                    'jobs_previous', 'jobs_change', 'user_trend'],
 'contract_status': ['team_id', 'company_name', 'latest_contract_end_date',
                     'days_to_contract_end', 'contract_status'],
 'at_risk_watchlist': ['team_id', 'company_name', 'region', 'company_size', 'active_users',
                       'total_clicks_wo_api', 'monthly_fee', 'fee_per_user',
                       'latest_contract_end_date', 'days_to_contract_end', 'contract_status',
                       'user_trend', 'months_since_start', 'client_stage', 'risk_flag'],
 'start_date': ['team_id', 'first_seen_month'],
 'client_tenure': ['team_id', 'company_name', 'first_seen_month', 'months_since_start'],
 'monthly_usage': ['snapshot_month', 'region', 'team_id', 'company_name', 'total_clicks_wo_api',
                   'active_users', 'active_coddlers', 'monthly_fee', 'jobs_posted'],
 'engagement_penalty_monthly': ['team_id', 'snapshot_month', 'decline_streak_length',
                                'engagement_penalty'],
 'user_monthly_penalty': ['team_id', 'company_name', 'snapshot_month', 'active_users',
                          'prev_active_users', 'user_pct_change', 'are_users_declining',
                          'reset_group', 'decline_streak_length', 'user_penalty'],
 'user_sharp_decline_penalty': ['team_id', 'company_name', 'snapshot_month', 'active_users',
                                'prev_active_users', 'user_pct_change', 'worst_3m_pct_change',
                                'is_user_sharp_decline', 'sharp_decline_penalty'],
 'jobs_posted_penalty_monthly': ['team_id', 'snapshot_month', 'decline_streak_length',
                                 'jobs_posted_penalty'],
 'pricing_exposure_monthly': ['team_id', 'company_name', 'snapshot_month', 'monthly_fee',
                              'active_users', 'company_size', 'fee_per_user',
                              'has_pricing_data'],
 'overall_health_score': ['team_id', 'company_name', 'snapshot_month', 'overall_health_score',
                          'engagement_penalty', 'user_penalty', 'sharp_decline_penalty',
                          'fee_per_user', 'health_band'],
 'health_penalties': ['team_id', 'company_name', 'snapshot_month', 'engagement_penalty',
                      'user_penalty'],
 'health_score_monthly': ['team_id', 'company_name', 'snapshot_month', 'health_score'],
 'health_narrative_monthly': ['team_id', 'company_name', 'snapshot_month', 'health_narrative'],
 'health_score_monthly_enriched': ['team_id', 'company_name', 'snapshot_month',
                                   'overall_health_score', 'health_band', 'health_narrative'],
 'company_overview': ['team_id', 'company_name', 'company_size', 'region', 'monthly_fee',
                      'salesperson', 'months_since_start', 'client_stage',
                      'overall_health_score'],
 'at_risk_next_actions': ['company_name', 'team_id', 'region', 'salesperson',
                          'overall_health_score', 'health_band', 'health_narrative',
                          'risk_flag', 'contract_status', 'days_to_contract_end', 'user_trend',
                          'engagement_delta', 'company_size', 'monthly_fee',
                          'recommended_action'],
 'onboarding_clients': ['team_id', 'company_name', 'salesperson', 'client_stage',
                        'months_since_start', 'onboarding_age_band', 'region', 'snapshot_month',
                        'total_clicks_wo_api', 'active_coddlers', 'monthly_fee',
                        'has_paid_users', 'active_users', 'total_resumes', 'total_jobs',
                        'hires_in_past_year'],
 'engagement_trend': ['team_id', 'company_name', 'snapshot_month', 'clicks_per_user',
                      'clicks_per_user_3m_avg', 'engagement_delta'],
 'user_trend_monthly': ['team_id', 'snapshot_month', 'active_users', 'prev_active_users',
                        'users_delta', 'users_pct_change'],
 'clicks_per_user_trend': ['company_name', 'team_id', 'snapshot_month', 'clicks_per_user',
                           'prev_clicks_per_user', 'clicks_per_user_delta',
                           'clicks_per_user_pct_change'],
 'user_mom_severity': ['team_id', 'company_name', 'snapshot_month', 'engagement_penalty',
                       'user_mom_decline']}
